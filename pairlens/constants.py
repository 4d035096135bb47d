"""Domains and fixed values.

Everything in the "fixed values" blocks must equal the values the explained
pipeline uses, otherwise results differ; they are stated once, here.
"""

# ---- fixed values: concept and direction domains -------------------------
CONCEPTS = ("food", "ambiance", "service", "noise")
NEGATIVE = "Negative"
UNKNOWN = "unknown"
POSITIVE = "Positive"
DIRECTIONS = (NEGATIVE, UNKNOWN, POSITIVE)

# ---- fixed values: 3-way aspect prediction codes --------------------------
ASPECT_CODE_TO_LABEL = {0: UNKNOWN, 1: NEGATIVE, 2: POSITIVE}
ASPECT_LABEL_TO_CODE = {NEGATIVE: 1, POSITIVE: 2, UNKNOWN: 0}

# ---- fixed values: review score encodings (score string -> class) --------
SCORE_ENCODINGS = {
    "2-way": {"1": 0, "2": 0, "4": 1, "5": 1},
    "3-way": {"1": 0, "2": 0, "3": 1, "4": 2, "5": 2},
    "5-way": {"1": 0, "2": 1, "3": 2, "4": 3, "5": 4},
}
NO_MAJORITY = "no majority"

# ---- fixed values: generation hygiene word lists --------------------------
# lower-cased substring tests, in this order
FAULT_WORDS = ("review", "reviewer", "instructor", "no information", "not mentioned",
               "mention", "mentioned", "there is no", "changed", "change")
# lower-cased, untrimmed suffix tests, in this order
FAULT_ENDINGS = ("the", "a", ",", "however", "unfortunately", "however,", "unfortunately,",
                 "but", "but,")

# ---- engine defaults (ours, not the explained pipeline's) -----------------
DEFAULT_SEED = 42
EXAMPLES_PER_ROLE = 5
ROLES = ("t_cf", "c_cf", "approx", "negative")
NORM_EPS = 1e-12
SIM_DIGITS = 9


def run_label(kind: str, **settings) -> str:
    """Label of an explainer run in score tables: its kind, then its settings by name."""
    shown = ",".join(f"{name}={settings[name]:g}" for name in sorted(settings))
    return f"{kind}({shown})" if shown else kind
