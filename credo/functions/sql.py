"""The column functions for SQL users: temporary SQL-bodied functions
(inlined into the plan like any expression, no Python at run time).

    register_sql_functions(spark)
    spark.sql("SELECT credo_norm_speaker(speaker_name) FROM f1")
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from credo.constants import CS_UNKNOWN_HUNDREDTHS, CS_WEIGHT_HUNDREDTHS, LABEL_MAP, LONG_Z, SHORT_Z
from credo.functions.text import ASCII_NON_WS, ASCII_WS_CLASS, WS_CLASS


def _strip(x: str) -> str:
    return f"regexp_replace({x}, r'^{WS_CLASS}+|{WS_CLASS}+$', '')"


def _case(x: str, mapping: dict, default: str = "NULL") -> str:
    return "CASE " + " ".join(f"WHEN {x} = '{k}' THEN {v}" for k, v in mapping.items()) + f" ELSE {default} END"


def definitions() -> dict[str, tuple[str, str, str]]:
    """name -> (parameters, return type, body)."""
    clean = "coalesce(x, '')"
    clean = f"regexp_replace({clean}, r'[^\\x00-\\x7F]+', ' ')"
    clean = f"regexp_replace({clean}, r'http{ASCII_NON_WS}+', '')"
    clean = f"trim(regexp_replace({clean}, r'{ASCII_WS_CLASS}+', ' '))"
    return {
        "credo_strip": ("x STRING", "STRING", _strip("x")),
        "credo_norm_speaker": ("x STRING", "STRING", f"regexp_replace({_strip('lower(x)')}, r'{WS_CLASS}+', '-')"),
        "credo_norm_context": ("x STRING", "STRING", f"lower({_strip('x')})"),
        "credo_norm_affil": ("x STRING", "STRING", f"lower({_strip('x')})"),
        "credo_clean": ("x STRING", "STRING", clean),
        "credo_norm_label": ("x STRING", "STRING", f"lower({_strip('x')})"),
        "credo_binary_label": ("x STRING", "INT", f"CAST({_case('x', LABEL_MAP)} AS INT)"),
        "credo_cs_weight": ("x STRING", "DOUBLE",
                            f"({_case('x', CS_WEIGHT_HUNDREDTHS, str(CS_UNKNOWN_HUNDREDTHS))}) / 100.0D"),
        "credo_decide": ("p DOUBLE, t DOUBLE", "STRING", "CASE WHEN p >= t THEN 'TRUE' ELSE 'FALSE' END"),
        "credo_confidence": ("p DOUBLE, label STRING", "INT",
                             "CAST(bround(CASE WHEN label = 'TRUE' THEN p * 100.0D ELSE (1.0D - p) * 100.0D END, 0) AS INT)"),
        "credo_length_bucket": ("z DOUBLE", "STRING",
                                f"CASE WHEN z > {LONG_Z!r}D THEN 'unusually long' WHEN z < {SHORT_Z!r}D "
                                "THEN 'unusually short' ELSE 'typical length' END"),
    }


def register_sql_functions(spark: SparkSession) -> list[str]:
    names = []
    for name, (params, ret, body) in definitions().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({params}) RETURNS {ret} RETURN {body}")
        names.append(name)
    return names
