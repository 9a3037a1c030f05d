"""Small tables with the awkward cases every operator has to take."""

LONG = " ".join(f"w{i % 977} said{i % 13}" for i in range(6000)) + "." + "x" * 5000
BASE = "the quick brown fox jumps over the lazy dog and runs away from the old farm house near the river bank".split()

TEXTS = [
    None, "", " ", "\n\n", "one", "One TWO three four", "a b c d e", "A  b\tc d\ne f",
    " ".join(BASE), " ".join(BASE), " ".join(BASE).upper(), " ".join(BASE[:-1] + ["bend"]),
    " ".join(BASE + BASE[:3]), "Nt, Nt, Nt, Nt, Nt", "!!! ??? ...", "é ü 汉字 😀 ▁ <s> </s>",
    "mail a.b@c.example.org or +1 (555) 555-0100, host 10.0.0.1, card 4111 1111 1111 1111.",
    LONG,
]

#: Extra columns whose names operators might use themselves.
EXTRA = "size long, score double, node string, value string, kind int, bucket int, base string, text_a string, `_row` int, times int, target int, component_id int"


def documents(spark, empty=False):
    """Rows with null ids, sources and texts, repeated rows and an id with two texts."""
    rows = [(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in enumerate(TEXTS)]
    rows += [(None, "a b c d e", None, None, None), (4, "one", "en", "src1", 3), (4, "one", "en", "src1", 3), (None, None, None, None, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    return spark.createDataFrame([] if empty else rows, schema)


def with_extra(df):
    from pyspark.sql import functions as F

    names = [part.strip().split()[0].strip("`") for part in EXTRA.split(",")]
    kinds = [part.strip().split()[1] for part in EXTRA.split(",")]
    return df.select("*", *(F.lit(None).cast(k).alias(n) for n, k in zip(names, kinds)))


def write_documents(spark, folder, empty=False, extra=True):
    """A folder with documents.parquet."""
    docs = documents(spark, empty)
    (with_extra(docs) if extra else docs).coalesce(2).write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def set_of(text):
    """A document's set of 5-word shingles, exactly."""
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()
