"""Fixed values that are part of the query semantics."""

# Polarity order and ids.
POLARITIES = ("negative", "neutral", "positive")
# Aspects in order.
ASPECTS = ("overall", "delivery", "build_quality", "battery", "customer_service", "display", "software", "performance", "price", "camera", "design", "audio")
# Ranking axes in slider order, and their labels.
AXES = ("battery", "camera", "price", "display", "performance")
AXIS_LABELS = {"battery": "Battery", "camera": "Camera", "price": "Price", "display": "Display", "performance": "Processor"}
# Score anchors for negative, neutral, positive; lower edges of label bands.
ANCHORS = (0.0, 0.5, 1.0)
BANDS = ((1.0, "Extremely Negative"), (1.75, "Negative"), (3.25, "Slightly Negative"), (4.75, "Neutral"), (6.25, "Slightly Positive"), (7.75, "Positive"), (9.25, "Extremely Positive"))
TOP_EDGE = 10.0001
# Candidate filters.
MIN_REVIEWS, REVIEW_CAP, SEED, MIN_WORDS = 20, 400, 0, 3
PUBLICATION_FLOOR = 15
# Evidence.
EVIDENCE_MIN_CHARS, EVIDENCE_PER_PRODUCT, EVIDENCE_SEPARATOR, EVIDENCE_CAP = 20, 12, " || ", 400
# Sentence units and input limits.
UNIT_MIN_WORDS, UNIT_MAX_WORDS, REVIEW_CHARS = 3, 60, 5000
WEIGHT_FLOOR, DETECTION_THRESHOLD, CONFIDENT = 1e-6, 0.5, 0.7
ECE_BINS = 10
# Resampling.
BOOTSTRAP_DRAWS, SPLIT_REPEATS = 5000, 25
# Tie order of a majority vote.
VOTE_ORDER = ("neutral", "negative", "positive")
SPLIT_PRIORITY = ("test", "dev", "train")
