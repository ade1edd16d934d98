"""Fixed values the results depend on: word lists, thresholds, weights and rates, stated plainly."""

# --- enums -----------------------------------------------------------------------------------------------------
CONDITIONS = ["new", "like_new", "good", "fair", "unknown"]
LENGTH_CLASSES = ["micro", "mini", "above_knee", "knee", "midi", "mid_calf", "maxi", "floor"]
SILHOUETTES = ["a_line", "sheath", "wrap", "fit_and_flare", "slip", "shirt", "bodycon", "tent", "empire", "other"]
NECKLINES = ["v_neck", "crew", "scoop", "square", "sweetheart", "halter", "off_shoulder", "one_shoulder", "cowl",
             "boat", "high_neck", "collared", "strapless", "keyhole"]
SLEEVES = ["sleeveless", "spaghetti_strap", "strapless", "cap", "short", "elbow", "three_quarter", "long", "puff",
           "balloon", "flutter", "bell"]
PATTERNS = ["solid", "floral", "ditsy_floral", "polka_dot", "stripe", "gingham", "plaid", "paisley", "animal",
            "abstract", "geometric", "tie_dye"]
OCCASIONS = ["casual", "work", "cocktail", "formal", "wedding_guest", "date_night", "brunch", "vacation", "party"]
AUDIENCES = ["adult", "child"]
HEM_POSITIONS = ["upper_thigh", "above_knee", "knee", "below_knee", "mid_calf", "ankle", "floor"]

# --- money -----------------------------------------------------------------------------------------------------
FX_TO_USD = {"USD": 1.0, "GBP": 1.27, "EUR": 1.08, "AUD": 0.66, "CAD": 0.73}

# --- sizes -----------------------------------------------------------------------------------------------------
ALPHA_SIZES = {
    "XXS": [0], "XS": [0, 2], "S": [4, 6], "M": [8, 10], "L": [12, 14], "XL": [16], "XXL": [18],
    "1X": [16, 18], "2X": [20, 22], "3X": [24, 26],
}
MAX_US_SIZE = 26
VINTAGE_SHIFT = (2, 6)

# --- freshness -------------------------------------------------------------------------------------------------
FRESH_HOURS_BY_KIND = {"ebay": 24, "shopify": 48, "fixture": 96}
FRESH_HOURS_DEFAULT = 96
RESALE_SOURCE = r"(?i)(^|:)ebay\b|poshmark|depop|resale"
HALF_LIFE_DAYS_RESALE = 7.0
HALF_LIFE_DAYS_OTHER = 21.0

# --- hem -------------------------------------------------------------------------------------------------------
HEEL_FACTOR = 0.85
SHOULDER_RATIO = 0.82
WAIST_RATIO = 0.62
STRETCH_DROP = 1.0
CLASS_PRIOR_INCHES = {"micro": 30.0, "mini": 33.0, "above_knee": 36.0, "knee": 39.0, "midi": 44.0, "mid_calf": 47.0,
                      "maxi": 55.0, "floor": 60.0}
HEM_BANDS = [(0.42, "upper_thigh"), (0.31, "above_knee"), (0.26, "knee"), (0.2, "below_knee"), (0.12, "mid_calf"),
             (0.03, "ankle")]
CLASS_BELOW_INCHES = [(31.5, "micro"), (34.5, "mini"), (37.5, "above_knee"), (41.5, "knee"), (45.5, "midi"),
                      (51.0, "mid_calf"), (57.5, "maxi")]

# --- fit -------------------------------------------------------------------------------------------------------
SILHOUETTE_EASE = {"bodycon": 1.0, "sheath": 1.5, "slip": 1.5, "a_line": 2.5, "wrap": 2.5, "fit_and_flare": 2.5,
                   "shirt": 2.5, "tent": 4.0, "empire": 4.0, "other": 2.0}
FIT_STRETCH = 1.0
FIT_SLACK = 2.0

# --- ranking ---------------------------------------------------------------------------------------------------
CANDIDATE_CAP = 500
PALETTE_BOOST_MAX = 1.25
PALETTE_HEX_DISTANCE = 80.0
RERANK_HEAD = 24
RERANK_WEIGHT = 0.6
EMBEDDING_WEIGHT = 0.6
SEARCH_WEIGHT = 0.7
RELEVANCE_WEIGHTS = {"attribute": 0.5, "semantic": 0.3, "lexical": 0.2}
SEMANTIC_TOP_K = 50
MAX_ADJACENT_BRAND = 2
DIVERSITY_WINDOW = 24
MAX_BRAND_PER_WINDOW = 6
MAX_SOURCE_PER_WINDOW = 12

# --- taste -----------------------------------------------------------------------------------------------------
SWIPE_PRESETS = {
    "package": {"rates": {"like": 0.25, "save": 0.3125, "dislike": -0.25, "skip": -0.05}, "clamp": 2.0, "prune": 0.01},
    "live": {"rates": {"like": 0.15, "save": 0.25, "dislike": -0.15, "skip": -0.03}, "clamp": 1.0, "prune": 0.005},
}
STYLE_SWIPE_LIMIT = 200
SAVE_VECTOR_WEIGHT = 1.25

# --- attribute tag weights -------------------------------------------------------------------------------------
TAG_WEIGHTS = {"length": 1.0, "silhouette": 1.0, "color": 0.8, "pattern": 0.7, "neckline": 0.5, "occasion": 0.4,
               "fabric": 0.6, "era": 0.6}

# --- keyword tables: (pattern, value), first match wins where one value is wanted ------------------------------
LENGTH_WORDS = [
    (r"\bmicro\b", "micro"),
    (r"\bmini\b", "mini"),
    (r"\babove[-\s]knee\b", "above_knee"),
    (r"\bshort\s+dress\b", "above_knee"),
    (r"\bknee[-\s]?length\b", "knee"),
    (r"\bknee\b", "knee"),
    (r"\bmidi\b", "midi"),
    (r"\b(mid[-\s]?calf|tea[-\s]?length)\b", "mid_calf"),
    (r"\bmaxi\b", "maxi"),
    (r"\bankle[-\s]?(?:length|grazing)\b", "maxi"),
    (r"\b(floor[-\s]?length|gown|full[-\s]?length)\b", "floor"),
]
SILHOUETTE_WORDS = [
    (r"\b(fit[-\s]?(?:and|&|n)[-\s]?flare|skater)\b", "fit_and_flare"),
    (r"\ba[-\s]?line\b", "a_line"),
    (r"\bsheath\b", "sheath"),
    (r"\bfaux[-\s]?wrap\b", "wrap"),
    (r"\bwrap\b", "wrap"),
    (r"\bslip\b", "slip"),
    (r"\b(shirt[-\s]?dress|shirtdress|shirt\s+silhouette)\b", "shirt"),
    (r"\b(bodycon|body[-\s]?con|bandage)\b", "bodycon"),
    (r"\b(trapeze|tent|swing|smock(?:ed)?\s+silhouette)\b", "tent"),
    (r"\bempire(?:[-\s]waist)?\b", "empire"),
    (r"\bshift\b", "sheath"),
    (r"\brelaxed\s+silhouette\b", "other"),
]
NECKLINE_WORDS = [
    (r"\bv[-\s]?neck\b", "v_neck"),
    (r"\b(crew|round)[-\s]?neck\b", "crew"),
    (r"\bcrew\b", "crew"),
    (r"\bscoop\b", "scoop"),
    (r"\bsquare[-\s]?neck\b", "square"),
    (r"\bsquare\b", "square"),
    (r"\bsweetheart\b", "sweetheart"),
    (r"\bhalter\b", "halter"),
    (r"\boff[-\s](?:the[-\s])?shoulder\b", "off_shoulder"),
    (r"\bone[-\s]shoulder\b", "one_shoulder"),
    (r"\bcowl\b", "cowl"),
    (r"\b(boat[-\s]?neck|boatneck|bateau)\b", "boat"),
    (r"\b(high[-\s]?neck|mock[-\s]?neck|turtleneck)\b", "high_neck"),
    (r"\b(collared|collar)\b", "collared"),
    (r"\bstrapless\b", "strapless"),
    (r"\bkeyhole\b", "keyhole"),
]
SLEEVE_WORDS = [
    (r"\bspaghetti[-\s]strap", "spaghetti_strap"),
    (r"\bsleeveless\b", "sleeveless"),
    (r"\bstrapless\b", "strapless"),
    (r"\bcap[-\s]sleeve", "cap"),
    (r"\bshort[-\s]sleeve", "short"),
    (r"\belbow[-\s]sleeve", "elbow"),
    (r"\b(three[-\s]quarter|3\/4)[-\s]sleeve", "three_quarter"),
    (r"\blong[-\s]sleeve", "long"),
    (r"\bpuff(?:ed)?[-\s]sleeve", "puff"),
    (r"\bballoon[-\s]sleeve", "balloon"),
    (r"\bflutter[-\s]sleeve", "flutter"),
    (r"\bbell[-\s]sleeve", "bell"),
]
PATTERN_WORDS = [
    (r"\bditsy[-\s]floral\b", "ditsy_floral"),
    (r"\bfloral\b", "floral"),
    (r"\bpolka[-\s]dot", "polka_dot"),
    (r"\bstripe[sd]?\b", "stripe"),
    (r"\bgingham\b", "gingham"),
    (r"\bplaid\b", "plaid"),
    (r"\bpaisley\b", "paisley"),
    (r"\b(animal(?:[-\s]print)?|zebra|snake(?:skin)?|cheetah)\b", "animal"),
    (r"\babstract\b", "abstract"),
    (r"\bgeometric\b", "geometric"),
    (r"\btie[-\s]dye\b", "tie_dye"),
    (r"\bsolid\b", "solid"),
]
FABRIC_WORDS = [
    (r"\bviscose\s+crepe\b", "viscose crepe"),
    (r"\bcotton\s+poplin\b", "cotton poplin"),
    (r"\bjersey(?:\s+knit)?\b", "jersey knit"),
    (r"\bsilk\s+charmeuse\b", "silk charmeuse"),
    (r"\bseersucker\b", "seersucker"),
    (r"\bchiffon\b", "chiffon"),
    (r"\bsatin\b", "satin"),
    (r"\bvelvet\b", "velvet"),
    (r"\btaffeta\b", "taffeta"),
    (r"\blinen\b", "linen"),
    (r"\blace\b", "lace"),
    (r"\bcrepe\b", "crepe"),
    (r"\bsilk\b", "silk"),
    (r"\brayon\b", "rayon"),
    (r"\bviscose\b", "viscose"),
    (r"\bpolyester\b", "polyester"),
    (r"\bcotton\b", "cotton"),
    (r"\bdenim\b", "denim"),
    (r"\bwool\b", "wool"),
    (r"\bknit\b", "knit"),
]
OCCASION_WORDS = [
    (r"\bwedding[-\s]guest\b", "wedding_guest"),
    (r"\bwedding\b", "wedding_guest"),
    (r"\bcocktail\b", "cocktail"),
    (r"\b(formal|black[-\s]tie|evening)\b", "formal"),
    (r"\b(work|office)\b", "work"),
    (r"\bdate[-\s]night\b", "date_night"),
    (r"\bbrunch\b", "brunch"),
    (r"\b(vacation|beach|resort)\b", "vacation"),
    (r"\bparty\b", "party"),
    (r"\b(casual|everyday)\b", "casual"),
]
# (pattern, name, family, hex)
COLOR_WORDS = [
    (r"\bburnt\s+orange\b", "burnt orange", "orange", "#CC5500"),
    (r"\bhot\s+pink\b", "hot pink", "pink", "#FF69B4"),
    (r"\bdusty\s+rose\b", "dusty rose", "pink", "#DCAE96"),
    (r"\bpowder\s+blue\b", "powder blue", "blue", "#B0E0E6"),
    (r"\bbutter\s+yellow\b", "butter yellow", "yellow", "#FFFD74"),
    (r"\bforest\s+green\b", "forest green", "green", "#228B22"),
    (r"\bcherry\s+red\b", "cherry red", "red", "#D2042D"),
    (r"\bburgundy\b", "burgundy", "red", "#800020"),
    (r"\bplum\b", "plum", "purple", "#8E4585"),
    (r"\blilac\b", "lilac", "purple", "#C8A2C8"),
    (r"\blavender\b", "lavender", "purple", "#B57EDC"),
    (r"\bpurple\b", "purple", "purple", "#800080"),
    (r"\bcharcoal\b", "charcoal", "gray", "#36454F"),
    (r"\bgr[ae]y\b", "gray", "gray", "#808080"),
    (r"\bblack\b", "black", "black", "#000000"),
    (r"\bivory\b", "ivory", "white", "#FFFFF0"),
    (r"\bcream\b", "cream", "white", "#FFFDD0"),
    (r"\bwhite\b", "white", "white", "#FFFFFF"),
    (r"\bnavy\b", "navy", "blue", "#000080"),
    (r"\bcobalt\b", "cobalt", "blue", "#0047AB"),
    (r"\bblue\b", "blue", "blue", "#0000CD"),
    (r"\bemerald\b", "emerald", "green", "#50C878"),
    (r"\bsage\b", "sage", "green", "#9CAF88"),
    (r"\bolive\b", "olive", "green", "#808000"),
    (r"\bgreen\b", "green", "green", "#008000"),
    (r"\bmustard\b", "mustard", "yellow", "#E1AD01"),
    (r"\byellow\b", "yellow", "yellow", "#FFD700"),
    (r"\bterracotta\b", "terracotta", "orange", "#E2725B"),
    (r"\brust\b", "rust", "orange", "#B7410E"),
    (r"\borange\b", "orange", "orange", "#FF8C00"),
    (r"\bblush\b", "blush", "pink", "#F4C2C2"),
    (r"\bpink\b", "pink", "pink", "#FFC0CB"),
    (r"\bred\b", "red", "red", "#DC143C"),
    (r"\bcamel\b", "camel", "brown", "#C19A6B"),
    (r"\bchocolate\b", "chocolate", "brown", "#5D3A1A"),
    (r"\btan\b", "tan", "brown", "#D2B48C"),
    (r"\bbrown\b", "brown", "brown", "#8B4513"),
    (r"\bleopard\b", "leopard", "brown", None),
    (r"\bgold\b", "gold", "metallic", "#D4AF37"),
    (r"\bsilver\b", "silver", "metallic", "#C0C0C0"),
    (r"\bbeige\b", "beige", "brown", "#F5F5DC"),
    (r"\bteal\b", "teal", "blue", "#008080"),
]
MAX_COLORS = 3
EXTRACT_CONFIDENCE = {"base": 0.1, "per_field": 0.05, "cap": 0.4}
CHILD_WORDS = (
    r"\bgirl'?s\b(?!'?\s+(?:night|trip|weekend|getaway))|\bkid'?s\b|\bchild(?:ren)?(?:'s)?\b|\btoddlers?\b|\binfants?\b"
    r"|\bnewborns?\b|\btweens?\b|\byouth\b|\bjunior\s+girls\b"
    r"|\bbaby\b(?!\s+(?:blues?\b|pinks?\b|yellows?\b|greens?\b|doll\b|showers?\b|bump\b)|'s\s+breath)"
    r"|\bmini[\s-]?me\b|\bmomm?y[\s-]?(?:and|&|n)[\s-]?me\b|\b(?:young|little)\s+(?:girl|boy)s?\b"
)

# --- measurements in text: (field, pattern, flat, from_waist) --------------------------------------------------
_NUM = r"(\d{1,3}(?:[.,]\d{1,2})?)"
_UNIT = r'\s*(cm|centimeters?|inches|inch|in\b|["”″])?'
MEASUREMENT_RULES = [
    ("length", rf"waist\s*to\s*hem\s*:?\s*{_NUM}{_UNIT}", False, True),
    ("length", rf"(?:full\s+)?length\s*:?\s*{_NUM}{_UNIT}", False, False),
    ("length", rf"{_NUM}{_UNIT}\s*(?:long|from\s+(?:high\s+point|shoulder|hps))", False, False),
    ("length", rf"(?:shoulder|hps)\s*to\s*hem\s*:?\s*{_NUM}{_UNIT}", False, False),
    ("bust", rf"(?:pit\s*to\s*pit|armpit\s*to\s*armpit|p2p|ptp)\s*:?\s*{_NUM}{_UNIT}", True, False),
    ("bust", rf"(?:bust|chest)\s*:?\s*{_NUM}{_UNIT}\s*flat", True, False),
    ("bust", rf"(?:bust|chest)\s*:?\s*{_NUM}{_UNIT}", False, False),
    ("waist", rf"waist\s*:?\s*{_NUM}{_UNIT}\s*flat", True, False),
    ("waist", rf"waist\s*:?\s*{_NUM}{_UNIT}", False, False),
    ("hip", rf"hips?\s*:?\s*{_NUM}{_UNIT}\s*flat", True, False),
    ("hip", rf"hips?\s*:?\s*{_NUM}{_UNIT}", False, False),
]
PLAUSIBLE_INCHES = {"bust": (24, 70), "waist": (18, 65), "hip": (26, 75), "length": (20, 75)}
CIRCUMFERENCE_FLOOR = {"bust": 28, "waist": 22, "hip": 30}
FLAT_CONTEXT = r"flat\s+measurements|measurements\s*\(flat\)|laid\s+flat"
MEASUREMENT_TOLERANCE = 1.5
