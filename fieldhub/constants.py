"""Lookup tables, word lists and rates that define the results.

Everything here is a plain value (no logic).  Changing one changes the numbers.
"""

from __future__ import annotations

# --- fixed values: registry column discovery -------------------------------
HEADCOUNT_COLUMNS = ["number_of_animals", "headcount", "animal_count", "animal_headcount"]
ANIMAL_COLUMNS = ["primary_animal_type", "animal_type", "primary_type_of_animal"]
STATUS_COLUMNS = ["status", "permit_status"]
DESIGNATION_COLUMNS = ["farm_designation", "designation"]
COUNTY_COLUMNS = ["farm_county", "county"]
CITY_COLUMNS = ["farm_city", "city"]
ZIP_COLUMNS = ["farm_zip", "zip_code", "farm_zip_code"]
CITY_STATE_ZIP_COLUMNS = ["city_state_zip"]
NAME_COLUMNS = ["farm_name", "name"]
ADDRESS_COLUMNS = ["farm_address", "address", "street_address"]
ANIMAL_KEYWORDS = [
    "horse", "cattle", "swine", "poultry", "broiler", "layer", "hen", "chicken",
    "sheep", "goat", "duck", "turkey", "veal", "pig", "cow",
]
NON_ANIMAL_KEYWORDS = ["qty", "building", "acres", "date", "noi", "status"]
PLACEHOLDER_LAT = 38.80
PLACEHOLDER_LON = -75.80

# --- fixed values: permit filters -------------------------------------------
ACTIVE_STATUSES = [
    "Registered", "Pending", "Notice of Preliminary Approval", "Issued",
    "Administratively Extended",
]
EASTERN_SHORE = [
    "Worcester", "Wicomico", "Caroline", "Somerset", "Dorchester", "Queen Anne's",
    "Kent", "Talbot",
]
INDUSTRIAL_HEADCOUNT = 100_000

# --- fixed values: animal types and nutrients --------------------------------
ANIMAL_ALIASES = {
    "broiler": "broiler_chicken",
    "broiler chicken": "broiler_chicken",
    "broilers": "broiler_chicken",
    "chickens": "broiler_chicken",
    "chicken": "broiler_chicken",
    "layer": "layer_chicken",
    "layers": "layer_chicken",
    "layer chicken": "layer_chicken",
    "turkey": "turkey",
    "turkeys": "turkey",
    "dairy": "dairy_cattle",
    "dairy cattle": "dairy_cattle",
    "beef": "beef_cattle",
    "beef cattle": "beef_cattle",
    "cattle": "beef_cattle",
    "swine": "swine",
    "hog": "swine",
    "hogs": "swine",
    "pig": "swine",
    "pigs": "swine",
}
# animal -> (N lbs/head/yr, P2O5 lbs/head/yr, flocks/yr), decimal text
NUTRIENT_COEFFICIENTS = {
    "broiler_chicken": ("0.91", "0.63", "6.5"),
    "layer_chicken": ("1.08", "0.86", "1"),
    "turkey": ("2.40", "1.80", "3"),
    "dairy_cattle": ("168.0", "96.0", "1"),
    "beef_cattle": ("125.0", "87.0", "1"),
    "swine": ("24.0", "18.0", "1"),
}
# crop -> (land-cover code, N lbs/acre, P2O5 lbs/acre)
CROP_DEMAND = {
    "corn": (1, 150.0, 60.0),
    "soybeans": (5, 0.0, 45.0),
    "winter_wheat": (24, 90.0, 40.0),
    "barley": (21, 80.0, 35.0),
    "sorghum": (4, 100.0, 40.0),
    "alfalfa": (36, 0.0, 50.0),
    "other_hay": (37, 60.0, 30.0),
    "vegetables": (42, 120.0, 80.0),
}

# --- fixed values: geometry --------------------------------------------------
KM_PER_DEGREE = 111.0
SQ_M_PER_ACRE = 4046.8564224
SQ_M_PER_ACRE_EXPORT = 4046.86
TARGET_BUFFER_KM = 2.0
TILE_SIZE_M = 1024.0
JOIN_RADIUS_M = 2000.0
FALLBACK_BOX_PX = 100

# --- fixed values: detection and embeddings ----------------------------------
DETECTION_CLASSES = ["poultry_house", "barn", "manure_lagoon", "feedlot", "silo"]
MIN_CONFIDENCE = 0.25
MIN_MASK_PX = 100
SIMILARITY_THRESHOLD = 0.70
NEUTRAL_SIMILARITY = 0.5
EMBEDDING_DIM = 64
MERGE_DISTANCE_PX = 12

# --- fixed values: size classes and map styling ------------------------------
SIZE_LABELS = ["<1K", "1K-10K", "10K-100K", "100K-1M", ">1M"]
SIZE_EDGES = [0, 1_000, 10_000, 100_000, 1_000_000]
HUB_COLOURS = [
    "red", "blue", "green", "purple", "orange", "darkred", "darkblue", "darkgreen",
    "cadetblue", "pink",
]

# --- fixed values: report wording ---------------------------------------------
PRIORITY_REASON = {
    "HIGH": "High AFO density and large animal population",
    "MEDIUM": "Significant AFO presence",
    "LOW": "Lower AFO concentration",
}
PRIORITY_ADVICE = {
    "HIGH": [
        "Excellent candidate for pilot digester program",
        "Consider 2-3 hubs within county boundaries",
        "High potential for economies of scale",
        "Engage with top 10 facilities for partnership",
    ],
    "MEDIUM": [
        "Good candidate for regional hub serving multiple counties",
        "Consider shared infrastructure with neighboring counties",
        "Focus on largest facilities first",
    ],
    "LOW": [
        "Better suited for regional hub access",
        "May not justify standalone county hub",
        "Include in multi-county service area",
    ],
}

# --- fixed values: siting and economics --------------------------------------
HUB_CAPACITY = 5_000_000
ANIMALS_PER_TRUCKLOAD = 25_000
TRIPS_PER_YEAR = 52
COST_PER_KM = 2.50
HUB_COST = 2_000_000
HORIZON_YEARS = 5
MAX_SITING_ROUNDS = 20
CONVERGED_MOVE = 100.0
MISSING_DISTANCE = 999_999.0
TRANSPORT_RATES = [1.50, 2.00, 2.50, 3.00, 3.50, 4.00]
CONSTRUCTION_COSTS = [1_500_000, 2_000_000, 2_500_000, 3_000_000]
ENERGY_PRICES = [0.08, 0.10, 0.12, 0.15, 0.18]
DIGESTATE_PRICES = [10, 15, 20, 25]
BASE_ENERGY_PRICE = 0.12
BASE_DIGESTATE_PRICE = 15
MANURE_KG_PER_DAY = 0.09
DAYS_PER_YEAR = 365
VOLATILE_SOLIDS = 0.20 * 0.70
BIOGAS_M3_PER_KG = 0.4
KWH_PER_M3 = 6.0
ELECTRIC_EFFICIENCY = 0.35
DIGESTATE_FRACTION = 0.95
GEOCODE_BATCH = 9_999

# runoff risk: distances to water count as so many metres at least; part of the risk left with hubs
RUNOFF_LEAST_METRES = 100.0
RUNOFF_LEFT = 0.1
