"""Column roles, domains and cut-offs of an energy-certificate register."""

from __future__ import annotations

# ---------------------------------------------------------------------------
# Bands, cut-offs and domain edges (public rating scale).
# ---------------------------------------------------------------------------
BANDS = ("A", "B", "C", "D", "E", "F", "G")
BAND_LOWER = {"A": 92, "B": 81, "C": 69, "D": 55, "E": 39, "F": 21, "G": 0}
BAND_UPPER = {"A": 100, "B": 91, "C": 80, "D": 68, "E": 54, "F": 38, "G": 20}
FALLBACK_BAND = "C"
SCORE_MIN, SCORE_MAX = 1.0, 100.0
TAIL_BANDS = ("E", "F", "G")

# Tokens that mean "not recorded" (compared upper-case, stripped).
SENTINELS = ("NODATA!", "NO DATA!", "NODATA", "NO DATA", "INVALID!", "NOT DEFINED")
# Tokens a CSV reader usually takes for null; off unless asked for.
CSV_NULL_TOKENS = ("NONE", "N/A", "NULL", "NA", "NAN", "#N/A")
MISSING_LEVEL = "__MISSING__"

# Construction-age band -> representative year.
AGE_BAND_YEAR = {
    "before 1900": 1880,
    "1900-1929": 1914,
    "1930-1949": 1939,
    "1950-1966": 1958,
    "1967-1975": 1971,
    "1976-1982": 1979,
    "1983-1990": 1986,
    "1991-1995": 1993,
    "1996-2002": 1999,
    "2003-2006": 2004,
    "2007 onwards": 2009,
    "2007-2011": 2009,
    "2012 onwards": 2015,
    "2012-2021": 2016,
    "2022 onwards": 2023,
}
AGE_BAND_PREFIX = "England and Wales: "
AGE_YEAR_RANGE = (1850, 2050)

# Era labels. "lo" schemes are [lo, hi), "hi" schemes are (lo, hi].
ERA_LEFT_CLOSED = (
    (0, 1900, "pre-1900"), (1900, 1930, "1900-29"), (1930, 1950, "1930-49"), (1950, 1967, "1950-66"),
    (1967, 1983, "1967-82"), (1983, 1996, "1983-95"), (1996, 2007, "1996-06"), (2007, 2100, "2007+"),
)
ERA_RIGHT_CLOSED = (
    (0, 1900, "<1900"), (1900, 1950, "1900-49"), (1950, 1980, "1950-79"), (1980, 2010, "1980-09"),
    (2010, 2100, "2010+"),
)

# Patterns over the free-text fabric descriptions.
TEXT_FLAGS = {
    "FLAG_CAVITY_INSULATED": ("WALLS_DESCRIPTION", r"cavity wall.*(insulated|filled)"),
    "FLAG_SOLID_BRICK_BARE": ("WALLS_DESCRIPTION", r"solid brick.*(no insulation|as built|partial insulation)"),
    "FLAG_HEAT_PUMP": ("MAINHEAT_DESCRIPTION", r"heat pump"),
    "FLAG_TRIPLE_GLAZED": ("WINDOWS_DESCRIPTION", r"triple"),
    "FLAG_SINGLE_GLAZED": ("WINDOWS_DESCRIPTION", r"^(?!.*double).*single"),
    "FLAG_GAS_BOILER": ("MAINHEAT_DESCRIPTION", r"mains gas"),
    "FLAG_ELECTRIC_HEATING": ("MAINHEAT_DESCRIPTION", r"electric|storage heater"),
}
LOFT_DEPTH_PATTERN = r"(\d{2,3})[\s\p{Z}\x85]*mm"  # any Unicode white space before the unit
NO_LOFT_PATTERN = r"no insulation|loft insulation, no insulation"
LOFT_TARGET_MM = 270
# Wall kinds, highest precedence first.
WALL_KINDS = (
    ("timber_system", r"timber|system|cob"),
    ("stone", r"granite|sandstone|stone"),
    ("solid_brick", r"solid brick"),
    ("cavity", r"cavity"),
)

# ---------------------------------------------------------------------------
# Column roles.
# ---------------------------------------------------------------------------
ID, DWELLING, DATE, COHORT = "LMK_KEY", "UPRN", "INSPECTION_DATE", "REPORT_TYPE"
TARGET, SCORE, AREA = "CURRENT_ENERGY_RATING", "CURRENT_ENERGY_EFFICIENCY", "TOTAL_FLOOR_AREA"
SPECIALIST_COHORT = 101

ALIASES = {
    "ENVIRONMENT_IMPACT_CURRENT": "ENVIRONMENTAL_IMPACT_CURRENT",
    "ENVIRONMENT_IMPACT_POTENTIAL": "ENVIRONMENTAL_IMPACT_POTENTIAL",
}
ROLES = {
    "leakage": (
        "CURRENT_ENERGY_EFFICIENCY", "POTENTIAL_ENERGY_RATING", "POTENTIAL_ENERGY_EFFICIENCY",
        "ENVIRONMENT_IMPACT_CURRENT", "ENVIRONMENT_IMPACT_POTENTIAL",
        "ENVIRONMENTAL_IMPACT_CURRENT", "ENVIRONMENTAL_IMPACT_POTENTIAL",
        "ENERGY_CONSUMPTION_CURRENT", "ENERGY_CONSUMPTION_POTENTIAL",
        "CO2_EMISSIONS_CURRENT", "CO2_EMISS_CURR_PER_FLOOR_AREA", "CO2_EMISSIONS_POTENTIAL",
        "LIGHTING_COST_CURRENT", "LIGHTING_COST_POTENTIAL", "HEATING_COST_CURRENT",
        "HEATING_COST_POTENTIAL", "HOT_WATER_COST_CURRENT", "HOT_WATER_COST_POTENTIAL",
    ),
    "element": (
        "HOT_WATER_ENERGY_EFF", "HOT_WATER_ENV_EFF", "FLOOR_ENERGY_EFF", "FLOOR_ENV_EFF", "WINDOWS_ENERGY_EFF",
        "WINDOWS_ENV_EFF", "WALLS_ENERGY_EFF", "WALLS_ENV_EFF", "SHEATING_ENERGY_EFF", "SHEATING_ENV_EFF",
        "ROOF_ENERGY_EFF", "ROOF_ENV_EFF", "MAINHEAT_ENERGY_EFF", "MAINHEAT_ENV_EFF", "MAINHEATC_ENERGY_EFF",
        "MAINHEATC_ENV_EFF", "LIGHTING_ENERGY_EFF", "LIGHTING_ENV_EFF",
    ),
    "personal": ("ADDRESS1", "ADDRESS2", "ADDRESS3", "ADDRESS", "POSTCODE", "UPRN", "BUILDING_REFERENCE_NUMBER"),
    "admin": (
        "LOCAL_AUTHORITY", "LOCAL_AUTHORITY_LABEL", "CONSTITUENCY", "CONSTITUENCY_LABEL", "COUNTY", "POSTTOWN",
        "LODGEMENT_DATETIME", "UPRN_SOURCE",
    ),
    "core": (
        "TOTAL_FLOOR_AREA", "NUMBER_HABITABLE_ROOMS", "WALLS_DESCRIPTION", "ROOF_DESCRIPTION",
        "WINDOWS_DESCRIPTION", "MAINHEAT_DESCRIPTION", "CONSTRUCTION_AGE_BAND", "PROPERTY_TYPE", "BUILT_FORM",
    ),
    "description": (
        "WALLS_DESCRIPTION", "ROOF_DESCRIPTION", "WINDOWS_DESCRIPTION", "MAINHEAT_DESCRIPTION",
        "MAINHEATCONT_DESCRIPTION", "HOTWATER_DESCRIPTION", "FLOOR_DESCRIPTION", "LIGHTING_DESCRIPTION",
        "SECONDHEAT_DESCRIPTION",
    ),
    "methodology": ("REPORT_TYPE", "LODGEMENT_DATE"),
    "superseded": ("FLOOR_LEVEL",),
}

# ---------------------------------------------------------------------------
# Declared schemas, column -> Spark type, in file order.
# ---------------------------------------------------------------------------
CERTIFICATE_TYPES = {
    "LMK_KEY": "string", "ADDRESS1": "string", "ADDRESS2": "string", "ADDRESS3": "string", "POSTCODE": "string",
    "BUILDING_REFERENCE_NUMBER": "string", "CURRENT_ENERGY_RATING": "string", "POTENTIAL_ENERGY_RATING": "string",
    "CURRENT_ENERGY_EFFICIENCY": "int", "POTENTIAL_ENERGY_EFFICIENCY": "int", "PROPERTY_TYPE": "string",
    "BUILT_FORM": "string", "INSPECTION_DATE": "date", "LOCAL_AUTHORITY": "string", "CONSTITUENCY": "string",
    "COUNTY": "string", "LODGEMENT_DATE": "date", "TRANSACTION_TYPE": "string",
    "ENVIRONMENTAL_IMPACT_CURRENT": "int", "ENVIRONMENTAL_IMPACT_POTENTIAL": "int",
    "ENERGY_CONSUMPTION_CURRENT": "double", "ENERGY_CONSUMPTION_POTENTIAL": "double",
    "CO2_EMISSIONS_CURRENT": "double", "CO2_EMISS_CURR_PER_FLOOR_AREA": "double",
    "CO2_EMISSIONS_POTENTIAL": "double", "LIGHTING_COST_CURRENT": "double", "LIGHTING_COST_POTENTIAL": "double",
    "HEATING_COST_CURRENT": "double", "HEATING_COST_POTENTIAL": "double", "HOT_WATER_COST_CURRENT": "double",
    "HOT_WATER_COST_POTENTIAL": "double", "TOTAL_FLOOR_AREA": "double", "ENERGY_TARIFF": "string",
    "MAINS_GAS_FLAG": "string", "FLOOR_LEVEL": "string", "FLAT_TOP_STOREY": "string",
    "FLAT_STOREY_COUNT": "double", "MAIN_HEATING_CONTROLS": "string", "MULTI_GLAZE_PROPORTION": "double",
    "GLAZED_TYPE": "string", "GLAZED_AREA": "string", "EXTENSION_COUNT": "int", "NUMBER_HABITABLE_ROOMS": "double",
    "NUMBER_HEATED_ROOMS": "double", "LOW_ENERGY_LIGHTING": "int", "NUMBER_OPEN_FIREPLACES": "int",
    "HOTWATER_DESCRIPTION": "string", "HOT_WATER_ENERGY_EFF": "string", "HOT_WATER_ENV_EFF": "string",
    "FLOOR_DESCRIPTION": "string", "FLOOR_ENERGY_EFF": "string", "FLOOR_ENV_EFF": "string",
    "WINDOWS_DESCRIPTION": "string", "WINDOWS_ENERGY_EFF": "string", "WINDOWS_ENV_EFF": "string",
    "WALLS_DESCRIPTION": "string", "WALLS_ENERGY_EFF": "string", "WALLS_ENV_EFF": "string",
    "SECONDHEAT_DESCRIPTION": "string", "SHEATING_ENERGY_EFF": "string", "SHEATING_ENV_EFF": "string",
    "ROOF_DESCRIPTION": "string", "ROOF_ENERGY_EFF": "string", "ROOF_ENV_EFF": "string",
    "MAINHEAT_DESCRIPTION": "string", "MAINHEAT_ENERGY_EFF": "string", "MAINHEAT_ENV_EFF": "string",
    "MAINHEATCONT_DESCRIPTION": "string", "MAINHEATC_ENERGY_EFF": "string", "MAINHEATC_ENV_EFF": "string",
    "LIGHTING_DESCRIPTION": "string", "LIGHTING_ENERGY_EFF": "string", "LIGHTING_ENV_EFF": "string",
    "MAIN_FUEL": "string", "WIND_TURBINE_COUNT": "double", "HEAT_LOSS_CORRIDOR": "string",
    "UNHEATED_CORRIDOR_LENGTH": "double", "FLOOR_HEIGHT": "double", "PHOTO_SUPPLY": "double",
    "SOLAR_WATER_HEATING_FLAG": "string", "MECHANICAL_VENTILATION": "string", "ADDRESS": "string",
    "LOCAL_AUTHORITY_LABEL": "string", "CONSTITUENCY_LABEL": "string", "POSTTOWN": "string",
    "CONSTRUCTION_AGE_BAND": "string", "LODGEMENT_DATETIME": "timestamp_ntz", "TENURE": "string",
    "FIXED_LIGHTING_OUTLETS_COUNT": "double", "LOW_ENERGY_FIXED_LIGHT_COUNT": "double", "UPRN": "bigint",
    "UPRN_SOURCE": "string", "REPORT_TYPE": "int",
}
RECOMMENDATION_TYPES = {
    "LMK_KEY": "string", "IMPROVEMENT_ITEM": "int", "IMPROVEMENT_SUMMARY_TEXT": "string",
    "IMPROVEMENT_DESCR_TEXT": "string", "IMPROVEMENT_ID": "int", "IMPROVEMENT_ID_TEXT": "string",
    "INDICATIVE_COST": "string",
}
# Columns cast to number before any rule is applied.
CLEAN_NUMERIC = tuple(c for c, kind in CERTIFICATE_TYPES.items() if kind in ("int", "double"))
LONGITUDINAL_NUMERIC = (
    "CURRENT_ENERGY_EFFICIENCY", "TOTAL_FLOOR_AREA", "NUMBER_HABITABLE_ROOMS", "NUMBER_HEATED_ROOMS",
    "CO2_EMISSIONS_CURRENT", "ENERGY_CONSUMPTION_CURRENT", "REPORT_TYPE",
)
CUTOFF = "2022-12-31"
