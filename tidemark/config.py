"""Column contract, targets and fixed parameters shared by every operator."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

ID = "row_id"
PERSON = "farmer_name"
DATE = "training_day"
DAY = "day"
TRAINER = "trainer"
TOPICS = "topics_list"
GROUP = "group_name"

# Target horizons in days and the matching label columns.
HORIZONS = {"07": 7, "90": 90, "120": 120}
LABELS = {h: f"adopted_within_{h}_days" for h in HORIZONS}
SCORES = {h: f"p{h}" for h in HORIZONS}

# Encoded and pass-through columns of the training log.
CATEGORICAL = ["gender", "registration", "age", "county", "subcounty", "ward"]
BINARY = ["belong_to_cooperative", "has_topic_trained_on"]
PROFILE_KEYS = {TRAINER: "trainer", GROUP: "group", "county": "county",
                "subcounty": "subcounty", "ward": "ward"}
ENCODED_KEYS = [TRAINER, GROUP, "county"]
GATING_KEYS = ["county", "subcounty", "ward", GROUP]

# Probability bounds, smoothing strength, support floors, fill values.
CLIP_LOW, CLIP_HIGH = 0.001, 0.999
PRIOR_STRENGTH = 10.0
Z95 = 1.96
MIN_SUPPORT = 10
PAIR_MIN_SUPPORT = 5
PAIR_SHRINK = 10.0
NO_HISTORY_DAYS = 999
UNSEEN_RATE = 0.5
PPMI_SHIFT = 1.0
LOOKBACK_DAYS = [7, 14, 30, 60, 90]
HISTORY_WEIGHT = 0.5
MAX_CLASS_WEIGHT = 25.0
SEED = 42

# score = sum of weight * (1 - LL / LL_SCALE) and weight * AUC per horizon.
LL_SCALE = 0.56926
LL_WEIGHT = {"07": 0.65, "90": 0.05, "120": 0.05}
AUC_WEIGHT = {"07": 0.15, "90": 0.05, "120": 0.05}

# Expected positive rates used by the unlabelled score report.
EXPECTED_RATES = {"07": 0.0113, "90": 0.0158, "120": 0.0223}

# Topic keyword lists of the farmer-training logs (case-insensitive substrings).
FARM_KEYWORDS = {
    "dairy": ["dairy", "milk", "cow", "calf", "lactating", "calving", "herd", "breeding",
              "silage", "fodder"],
    "poultry": ["poultry", "chicken", "kienyeji", "layers", "broiler", "biosecurity", "egg"],
    "crop": ["maize", "bean", "seed", "weed", "fertilizer", "pest", "crop", "topdressing",
             "planting"],
    "general": ["record", "hygiene", "ppe", "finance", "app", "ndume", "management",
                "vaccination", "health"],
}

# Keyword lists for logs derived from the order tables, whose topics are part names.
PART_KEYWORDS = {
    "fasteners": ["bolt", "rod", "ring"],
    "machines": ["gear", "gizmo", "widget"],
    "metal": ["anvil", "plate"],
    "colour": ["red", "blue"],
}


@dataclass(frozen=True)
class FeatureGroups:
    """Which feature blocks a matrix holds; an argument, never process state."""

    direct: bool = True
    dates: bool = True
    topics: bool = True
    trainer: bool = True
    person_history: bool = True
    aggregates: bool = True
    confidence: bool = True
    interactions: bool = False
    recency: bool = True
    quality: bool = False
    keywords: dict = field(default_factory=lambda: PART_KEYWORDS)

    def but(self, **changes) -> "FeatureGroups":
        return replace(self, **changes)


VETTED = FeatureGroups()
MINIMAL = FeatureGroups(dates=False, trainer=False, person_history=False, aggregates=False,
                        confidence=False, recency=False)
WARM = FeatureGroups(confidence=False, recency=False)
COLD = FeatureGroups(trainer=False, person_history=False, aggregates=False, confidence=False,
                     recency=False)
