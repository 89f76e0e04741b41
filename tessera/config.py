"""Run settings and the fixed values results depend on.

Library defaults follow the reference workload (10 realizations, 5/5 folds,
501 trees, the TF-IDF and paragraph-vector grids); registered queries use
small settings so they finish at test scale.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# ---------------------------------------------------------------------------
# FIXED VALUES - must equal the reference for equal results. Do not edit.
# French stop words (the word "pas" is deliberately not in the list).
STOP_WORDS = ("de", "ce", "cet", "cette", "la", "en", "et", "du", "d", "le", "l",
              "un", "une", "les", "des", "ces", "à", "au", "aux")
# Site-specific words removed by the custom-word step.
CUSTOM_WORDS = ("chuv", "onm1", "lausanne", "dre", "dr", "réf", "destinataire",
                "docteur", "preliminary", "1011", "n", "professeur", "assistante",
                "leonel", "cheffe", "page", "chef", "médecin", "v", "prof", "assistant")
# Tokens never removed as proper nouns.
KEEP_WORDS = ("Pas", "réséqué", "Comparatif", "oligodendrogliome", "Astrocytome",
              "punctiforme", "Gadolinium", "mastoïdiennes", "pseudophake", "ethmoïdal",
              "néoangiogénèse", "MPRAGE")
# Section markers.
INDICATION_MARKERS = ("indications", "Indications", "indication", "Indication")
DESCRIPTION_MARKERS = ("descriptions", "Descriptions", "description", "Description")
# Global label strings (leading blank included) and their codes.
GLOBAL_LABELS = ((" Global_stable", 0), (" Global_response", 1),
                 (" Global_progression", 2), (" Global_unknown", 3))
CLASS_NAMES_4 = ("stable", "response", "progression", "unknown")
CLASS_NAMES_2 = ("stable", "unstable")
# Value marking the classification entry of an annotation.
CLASSIFICATION_VALUE = "Classification"
# Hyper-parameter grids.
TFIDF_NGRAMS = (3, 4, 5)
TFIDF_PVS = (0.9, None)
RF_MAX_FEATURES = (0.8, 1.0)
D2V_SIZES = (10, 30, 50)
# Model settings.
N_TREES = 501
MIN_DF = 2
MAX_DF = 0.9
D2V_WINDOW = 5
D2V_MIN_COUNT = 2
D2V_EPOCHS = 100
CURVE_GRID = 100            # points of the averaged curve grid
# English month and weekday names a fuzzy date parser accepts as date parts.
DATE_WORDS = ("jan", "january", "feb", "february", "mar", "march", "apr", "april",
              "may", "jun", "june", "jul", "july", "aug", "august", "sep", "sept",
              "september", "oct", "october", "nov", "november", "dec", "december",
              "mon", "monday", "tue", "tues", "tuesday", "wed", "wednesday", "thu",
              "thur", "thurs", "thursday", "fri", "friday", "sat", "saturday",
              "sun", "sunday")
# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class CleanConfig:
    """Flags of the cleaning pipeline, in the order the steps run."""

    remove_proper_nouns: bool = True
    lowercase: bool = True
    remove_punctuation: bool = True
    remove_stopwords: bool = True
    remove_custom_words: bool = True
    from_indication_onward: bool = True
    from_description_onward: bool = False
    stop_words: tuple = STOP_WORDS
    custom_words: tuple = CUSTOM_WORDS
    keep_words: tuple = KEEP_WORDS
    indication_markers: tuple = INDICATION_MARKERS
    description_markers: tuple = DESCRIPTION_MARKERS
    # proper-noun lexicon rule (corpus aggregate)
    lexicon_min_count: int = 5
    lexicon_min_capital_share: float = 0.5


@dataclass(frozen=True)
class RunConfig:
    """Settings of a repeated nested cross-validation run."""

    realizations: int = 10
    outer_folds: int = 5
    inner_folds: int = 5
    n_trees: int = N_TREES
    max_depth: int = 30
    max_bins: int = 32
    ngrams: tuple = TFIDF_NGRAMS
    pvs: tuple = TFIDF_PVS
    max_features: tuple = RF_MAX_FEATURES
    d2v_sizes: tuple = D2V_SIZES
    d2v_epochs: int = D2V_EPOCHS
    d2v_partitions: int = 8
    min_df: int = MIN_DF
    max_df: float = MAX_DF
    binary: bool = True         # False: the four labels as they are
    run_date: str = "undated"   # names the run in stored results
    # Vocabulary size V behind the pvs cap: "corpus" = distinct cleaned tokens
    # of the whole corpus (the reference's rule, test rows included); "train" =
    # distinct unigrams of the split's own training rows.
    vocab_scope: str = "corpus"
    concurrent_fits: int = 4
    clean: CleanConfig = field(default_factory=CleanConfig)
