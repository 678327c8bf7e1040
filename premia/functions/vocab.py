"""Business vocabulary shared by the engine and its SQL oracle.

FIXED VALUES: the strings and numbers below must equal the source system's
for results to match. They are stated as plain text, in natural order.
"""

# FIXED VALUES — transaction codes.
NEW_POLICY = "New Policy Line"
RENEW_POLICY = "Renew Policy"
MID_TERM_ADJUSTMENT = "Mid Term Adjustment"
CANCEL_POLICY = "Cancel Policy Line"
REINSTATE_POLICY = "Reinstate Policy Line"
TRANS_CODES = [NEW_POLICY, RENEW_POLICY, MID_TERM_ADJUSTMENT, CANCEL_POLICY, REINSTATE_POLICY]

# FIXED VALUES — budget metric names (long-format plan / forecast facts).
BUDGET_METRICS = [
    "GWP",
    "NBW_GWP",
    "RENEWAL_GWP",
    "NBW_UNIQUE_PETS",
    "RENEWAL_UNIQUE_PETS",
    "AVG_NBW_PREMIUM",
    "AVG_RENEWAL_PREMIUM",
]

# FIXED VALUES — the one budget dimension type that queries read.
TOTAL_DIMENSION = "Total"

# FIXED VALUES — raw channel and sub-channel values read by the classifiers.
CH_DTC = "DTC"
CH_AGGREGATOR = "Aggregator"
CH_VETERINARY = "Veterinary"
CH_EMPLOYEE_BENEFITS = "Employee Benefits"
CH_PARTNER = "Partner"
SUB_REFERRAL = "Referral Program"

# FIXED VALUES — classifier outputs.
PRODUCT_LABELS = {  # (wellness, accident) -> product
    (0, 0): "AI",
    (0, 1): "AO",
    (1, 0): "AI-WELL",
    (1, 1): "AO-WELL",
}
CHANNEL5_BLANK = "DTC (non-Aggs)"
CHANNEL5_LABELS = {
    "DTC": "DTC",
    "Aggregator": "Aggregator",
    "Veterinary": "Vet",
    "Employee Benefits": "Employee Benefits",
    "Partner": "Partner",
}
CHANNEL6_BLANK = "DTC (non-Aggs) - Add"
CHANNEL6_REFERRED = "Referred by Friend"
CHANNEL6_LABELS = {
    "DTC": "DTC Direct",
    "Aggregator": "Aggregator",
    "Veterinary": "Vet / All Other Vets",
    "Employee Benefits": "EB Direct Bill",
    "Partner": "Affinity / Partner",
}
OTHER = "Other"
VENDOR5_VET_DEFAULT = "All Other Vets"
VENDOR5_AGGREGATOR = "Aggregator Marketplace"
VENDOR5_REFERRED = "Referred by Friend"
VENDOR5_EMPLOYEE_BENEFITS = "Employee Benefits"
VENDOR5_PARTNER = "Partner Network"
VENDOR5_DEFAULT = "DTC / Other"
VENDOR6_VET_DEFAULT = "Vet / Other"
VENDOR6_AGGREGATOR_DEFAULT = "Aggregator"
VENDOR6_REFERRED = "Referred by Friend"
VENDOR6_DTC = "DTC"
VENDOR6_EMPLOYEE_BENEFITS = "EB Discount Sites"
VENDOR6_PARTNER = "Affinity Partner"
CHANNEL_KEY_BLANK = "DTC (non-Aggs) - Add"

# FIXED VALUES — vendor column priority when a fact carries several.
VENDOR_COLUMN_PRIORITY = ["vendor_5", "vendor_6", "vendor"]

# FIXED VALUES — month labels of the 12-month spine.
MONTH_LABELS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]

# FIXED VALUES — display strings.
NULL_DISPLAY = "—"
PLAN_DELTA_PREFIX = "vs Plan "

# FIXED VALUES — rating factors of the synthetic generator.
RATING_BASE_MEAN = 420.0
RATING_BASE_SD = 95.0
RATING_SPECIES = {"Dog": 1.12, "Cat": 0.88}
RATING_PRODUCT = {"AO": 0.78, "AI": 1.00, "AI-WELL": 1.18, "AO-WELL": 1.32}
RATING_HIGH_COST_STATES = ["CA", "NY", "NJ", "MA", "WA", "FL", "TX"]
RATING_HIGH_COST_FACTOR = 1.10
RATING_FLOOR = 85.0
RATING_CODE_FACTORS = {  # code -> (mean, sd, sign)
    "New Policy Line": (1.03, 0.06, 1),
    "Renew Policy": (1.08, 0.05, 1),
    "Mid Term Adjustment": (0.18, 0.12, 1),
    "Reinstate Policy Line": (0.45, 0.12, 1),
    "Cancel Policy Line": (0.35, 0.15, -1),
}

# FIXED VALUES — budget allocation constants.
PLAN_BASES = {  # metric -> (base amount, seasonal)
    "GWP": (52000000, True),
    "NBW_GWP": (17000000, True),
    "RENEWAL_GWP": (35000000, True),
    "NBW_UNIQUE_PETS": (38000, True),
    "RENEWAL_UNIQUE_PETS": (86000, True),
    "AVG_NBW_PREMIUM": (455, False),
    "AVG_RENEWAL_PREMIUM": (505, False),
}
PLAN_SEASONAL_AMPLITUDE = 0.08
PLAN_SEASONAL_GROWTH = 0.012
PLAN_AVERAGE_GROWTH = 0.002
FORECAST_MEAN_BIAS = 1.015
FORECAST_FIRST_MONTH = 5
PLAN_FIXTURE_WEIGHTS = [  # (dimension_type, dimension_value, weight)
    ("Total", "All", 1.0),
    ("PRODUCT", "AI", 0.32),
    ("PRODUCT", "AO", 0.18),
    ("PRODUCT", "AI-WELL", 0.28),
    ("PRODUCT", "AO-WELL", 0.22),
    ("Species", "Dog", 0.68),
    ("Species", "Cat", 0.32),
]
