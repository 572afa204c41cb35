"""Names and fixed parameters shared by the operators."""

CHANNELS = ["humidity", "tmp", "tmp_range", "tmp_max", "tmp_min",
            "surf_tmp", "surf_pre", "wb_tmp", "prec"]
STATS = ["mean", "std", "min", "max", "sum", "p95"]
HORIZONS = [1, 2, 3, 4, 5]
SCORE_MAX = 5

KEY = "region_id"
DAY = "day_idx"
WEEK = "week_idx"

DAYS_PER_WEEK = 7
LAG_WINDOW = 12
SCORE_LAGS = [1, 2, 4, 8, 52]
SCORE_LAG_SHIFT = 12
NONZERO_CAP = 26

ROLL_DAYS = [7, 14, 21, 42, 91]
ROLL_WEEKS = [4, 8, 12]
SLOPE_CHANNELS = ["tmp", "prec", "humidity", "surf_tmp", "tmp_range"]
ANOMALY_CHANNELS = ["tmp_max", "tmp_min", "prec", "humidity", "surf_pre", "tmp_range"]
TREND_COLUMNS = ["prec_mean", "tmp_max_mean", "tmp_range_mean", "humidity_mean"]
RANK_CHANNELS = ["humidity", "wb_tmp", "tmp_range", "tmp", "tmp_max", "surf_tmp", "tmp_min"]
TRANSFORMS = {"prec": "log1p", "surf_pre": "sqrt"}

# Rows of one entity handled by one window task; see functions/chunks.py.
DAY_CHUNK = 1024
WEEK_CHUNK = 256
