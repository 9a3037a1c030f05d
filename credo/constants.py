"""Fixed values that must equal the source semantics for identical results.

Everything below is a fixed value, stated in natural order.
"""

import numpy as np

# --- fixed values: six-class labels -> binary TRUE(1)/FALSE(0) ---------------
LABEL_MAP = {
    "true": 1,
    "mostly-true": 1,
    "half-true": 1,
    "barely-true": 0,
    "false": 0,
    "extremely-false": 0,
}

# --- fixed values: falsehood weight per label, in integer hundredths ---------
# (0.00, 0.20, 0.50, 0.75, 0.90, 1.00); unknown labels weigh 0.50.
CS_WEIGHT_HUNDREDTHS = {
    "true": 0,
    "mostly-true": 20,
    "half-true": 50,
    "barely-true": 75,
    "false": 90,
    "extremely-false": 100,
}
CS_UNKNOWN_HUNDREDTHS = 50

# --- fixed values: defaults ------------------------------------------------
CS_DEFAULT = 0.5              # credit score of a speaker unseen in training
DEFAULT_CRED_FALLBACK = 0.557  # used only when no artifact provides one
THRESHOLD_FALLBACK = 0.57      # used only when no artifact provides one
LEN_MEAN_FALLBACK = 50.0       # used only when the training split is empty
LEN_STD_FALLBACK = 20.0        # used only when the training split is empty
LEN_STD_EPSILON = 1e-8
MAX_LEN = 128                  # tokens incl. the two special tokens
SPLIT_SEED = 42

# --- fixed values: numeric features, in attribution order -----------------
FEATURE_NAMES = ["cs_ratio", "speaker_cred", "affil_cred", "ctx_cred", "len_norm"]

# --- fixed values: special tokens dropped from word attributions ----------
SPECIAL_TOKENS = ["[CLS]", "[SEP]", "[PAD]"]

# --- fixed values: attribution quality bands (completeness delta) ---------
DELTA_EXCELLENT = 0.05
DELTA_ACCEPTABLE = 0.20

# --- fixed values: explanation rules --------------------------------------
SPEAKER_CRED_SKIP_BAND = 0.02
LONG_Z = 1.0
SHORT_Z = -1.0
TOP_WORDS = 3
EVIDENCE_LINES = 3

# --- fixed values: the 41 decision thresholds 0.30 .. 0.70 ----------------
# Produced by the same rule as the original sweep (a float arange), so entry
# 5 is 0.35000000000000003 and entry 18 is 0.48000000000000015.
THRESHOLDS = [float(t) for t in np.arange(0.30, 0.71, 0.01)]

# --- fixed values: NA spellings read as NULL from CSV (pandas defaults) ---
NA_STRINGS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]
