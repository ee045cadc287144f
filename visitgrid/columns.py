"""Column names and default parameters shared by all operators."""

# Canonical column names and the renames applied on load.
V_NUMBER, BT_NUMBER, AT_NUMBER = "v_nummer", "bt_nummer", "at_nummer"
JOIN_KEY = "_join_key"
START, END, STATUS, PACKAGE = "umr_start", "umr_av", "umr_status", "umr_art"
DEADLINE, SOP, CAR_READY = "rueckgabe_soll", "sop", "av_fzg"
LABEL = "came_for_retrofit"
DURATION = "retrofit_duration_days"
UNKNOWN = "UNKNOWN"
CANCELLED, COMPLETED, FORECAST = "Cancelled", "Completed", "Forecast"

# Header renames of the two CSV inputs.
RENAME_VISITS = {
    "start_ur": "umr_start",
    "av_ur": "umr_av",
    "av_first_istufe": "av_erstaufbau",
    "umruststatus": "umr_status",
    "umruestart": "umr_art",
}
RENAME_ENTITIES = {
    "vnumber": "v_nummer",
    "btnumber": "bt_nummer",
    "at_id": "at_nummer",
    "anlauf_sop_at": "sop",
    "prio_int": "prio",
}

# Thresholds of the scoring steps.
FORECAST_THRESHOLD = 0.05
MIN_TYPE_PROBABILITY = 0.02
HORIZON_MONTHS = 24
DEFAULT_GAP_DAYS = 120
CAL_LO, CAL_HI = 0.5, 1.5
BLEND_DUAL_MODEL = 0.30
BLEND_TRIPLE = (0.30, 0.40, 0.30)
TS_WEIGHT = 0.30
ATYPICAL_PENALTY, MISMATCH_PENALTY = 0.8, 0.3
MIN_TEST_ROWS = 500

# Key chains, the documented priority and the one the fill order gives in effect.
KEY_CHAIN = (AT_NUMBER, BT_NUMBER, V_NUMBER)
KEY_CHAIN_EFFECTIVE = (V_NUMBER, BT_NUMBER, AT_NUMBER)

# Columns that identify a row.
ID_COLUMNS = {V_NUMBER, BT_NUMBER, AT_NUMBER, JOIN_KEY, "_merge"}

# Columns that leak a duration target.
DURATION_LEAKS = {
    "umr_start", "umr_av", "av_erstaufbau", "ziel_sab",
    "month", "quarter", "year", "day_of_week", "week_of_year",
    "monthly_retrofit_count", "lead_time_category", "lead_time_category_clean",
    "car_ready_age_months", "retrofit_ready_age_months",
    "car_ready_category", "retrofit_ready_category",
    "is_recent_av_fzg", "is_recent_av_retrofit",
}

# Metadata columns of the export table.
EXPORT_FORECAST_COLUMNS = (
    "prob_coming", "type_probability", "visit_number", "calibration_weight",
    "forecast_binary_approach", "forecast_binary_model",
    "forecast_multiclass_model", "forecast_duration_model",
    "forecast_threshold", "forecast_timestamp",
)
