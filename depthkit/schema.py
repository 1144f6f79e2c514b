"""Default column names, thresholds and alias tables.

The values under "Fixed values" must equal those of the workflow this library reproduces
(curve mnemonics, operator names, sentinels, physical ranges, lithology cut-offs) for the
results to agree; they are stated here once, in natural order.
"""

from __future__ import annotations

GROUP = "well_api"
ORDER = "DEPTH"
SRC_ROW = "src_row"
TARGET = "GR"
ID_COLUMNS = ["DEPTH", "well_api", "well_name", "operator", "filename"]

# ---------------------------------------------------------------------------------------
# Fixed values
# ---------------------------------------------------------------------------------------

# Null sentinels written by logging tools.
NULL_SENTINELS = [-999.25, -9999.0, -999.0]

# Physical ranges used for clipping (curve -> (low, high)).
CLIP_RANGES = {
    "GR": (10.0, 250.0),
    "RHOB": (1.5, 3.0),
    "NPHI": (0.0, 60.0),
    "PE": (0.0, 10.0),
}

# Default processing parameters.
TARGET_STEP = 1.0
IMPUTATION_THRESHOLD = 20.0
INTERPOLATE_BELOW_PCT = 5.0
HIGH_NULL_FLAG_PCT = 10.0
MAD_THRESHOLD = 5.0
MAD_FLAG_FRACTION = 0.01
ROLLING_WINDOWS = [5, 10, 20]
DIFF_LAGS = [1, 3, 5]
SEQUENCE_LENGTH = 50
SEQUENCE_STEP = 1
DEPTH_WINDOW = (4000.0, 12000.0)
RATIO_EPS = 1e-8
MIN_USABLE_ROWS = 10  # neighbour branch of the imputation policy: more rows than this
MAX_RATIO_CURVES = 6  # limits of the workflow, not applied unless passed
MAX_RATIO_FEATURES = 20
ZSCORE_THRESHOLD = 3.0

# Lithology thresholds.
LITHOLOGY = {
    "gr_shale_min": 80.0,
    "gr_sand_max": 50.0,
    "rhob_shale_max": 2.4,
    "nphi_shale_min": 20.0,
    "rt_source_min": 10.0,
}

# Gamma-ray intensity bins: right-closed (0,30], (30,50], (50,80], (80,150], (150,300].
GR_INTENSITY_EDGES = [0.0, 30.0, 50.0, 80.0, 150.0, 300.0]
GR_INTENSITY_LABELS = ["very_low", "low", "medium", "high", "very_high"]

# Evaluation lithology bands on the target: [0,75) shale-poor, [75,150), [150,300).
TARGET_BANDS = [(0.0, 75.0, "low"), (75.0, 150.0, "medium"), (150.0, 300.0, "high")]
VALID_PREDICTION_RANGE = (10.0, 250.0)

# Core curves eligible for pairwise ratios, in the order they are considered.
CORE_CURVES = ["GR", "RHOB", "NPHI", "RT", "PE", "CALI", "SP", "ROP", "TVD", "VS"]

# Operator-name aliases (raw company string -> standard operator).
OPERATOR_ALIASES = {
    "Chesapeake Energy": "Chesapeake",
    "Chesapeake": "Chesapeake",
    "Anadarko": "Anadarko",
    "Anadarko Petroleum Corporation": "Anadarko",
    "Anadarko Petroleum Company": "Anadarko",
    "Anadarko Petroeum Corporation": "Anadarko",
    "Premier Directional Drilling": "Anadarko",
    "Sanchez OG": "Sanchez",
    "Sanchez Oil & Gas": "Sanchez",
    "Sanchez O&G Corp": "Sanchez",
    "NEWFIELD EXPLORATION COMPANY": "Newfield",
    "CHOYA OPERATING, LLC": "Choya",
    "Choya Operating, LLC": "Choya",
    "CHESAPEAKE OPERATING, INC.": "Chesapeake",
}

# Curve mnemonic aliases (raw mnemonic -> standard curve name).
CURVE_ALIASES = {
    "DEPT": "DEPTH", "DEPTH": "DEPTH",
    "GR": "GR", "GR_1": "GR", "GR_RM": "GR", "GRGC": "GR", "GR_API": "GR",
    "DEN": "RHOB", "RHOB": "RHOB", "ZDNC": "RHOB", "HDEN": "RHOB",
    "NPHI": "NPHI", "CNCF": "NPHI", "NPRL": "NPHI", "NPRS": "NPHI", "NPRD": "NPHI",
    "RT": "RT", "RES": "RT", "M1R6": "RT", "M1R1": "RT", "M1R2": "RT", "M1R3": "RT",
    "PE": "PE", "PDPE": "PE",
    "CAL": "CALI", "CALI": "CALI",
    "SP": "SP", "SPCG": "SP",
}

# LAS ~Well header fields read into the header table (mnemonic -> column name).
LAS_HEADER_FIELDS = {
    "API": "api", "WELL": "well_name", "COMP": "company", "FLD": "field", "CNTY": "county",
    "STAT": "state", "DATE": "date", "STRT": "start_depth", "STOP": "stop_depth",
    "STEP": "step", "NULL": "null_value", "SRVC": "service_company", "UWI": "uwi",
}
LAS_NUMERIC_HEADERS = ["STRT", "STOP", "STEP", "NULL"]
