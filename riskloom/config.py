"""Column roles, windows, weights and thresholds.

Fixed values that must equal the reference pipeline's configuration
(config file, scorer constants):
  time windows (seconds) ......... 3600, 86400, 604800 labelled 1h, 24h, 7d
  ensemble weights ............... lgbm 0.60, graph 0.25, anomaly 0.15
  risk thresholds ................ CRITICAL >= 0.65, HIGH >= 0.40, MEDIUM >= 0.20, else LOW
  device-type risk ............... mobile 0.4, desktop 0.2, unknown 0.6, other 0.5
  categorical fill ............... "Unknown"
  validation fraction ............ 0.2
  anomaly forest ................. 200 trees, contamination 0.002, seed 42
  random-walk embedding .......... dim 64, walk length 20, 50 walks, p 1, q 0.5, window 10
  boosted trees .................. learning rate 0.03, max depth 8, subsample 0.7, colsample 0.7, seed 42
"""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Roles:
    id: str = "TransactionID"
    time: str = "TransactionDT"
    amount: str = "TransactionAmt"
    target: str = "isFraud"
    card: str = "card1"
    device: str = "DeviceInfo"
    device_type: str = "DeviceType"
    email: str = "P_emaildomain"
    addr: str = "addr1"
    product: str = "ProductCD"


ROLES = Roles()

# velocity windows: (seconds, label)
TIME_WINDOWS: tuple[tuple[int, str], ...] = ((3600, "1h"), (86400, "24h"), (604800, "7d"))

CAT_FILL = "Unknown"

# columns that are always categorical when present
CATEGORICAL_COLS: tuple[str, ...] = (
    "ProductCD", "card4", "card6", "P_emaildomain", "R_emaildomain",
    "DeviceType", "DeviceInfo",
    "M1", "M2", "M3", "M4", "M5", "M6", "M7", "M8", "M9",
    "id_12", "id_15", "id_16", "id_23", "id_27", "id_28", "id_29", "id_30",
    "id_31", "id_33", "id_34", "id_35", "id_36", "id_37", "id_38",
)

# not model features (trainer's list, used everywhere)
NON_FEATURE_COLS: tuple[str, ...] = (
    "isFraud", "TransactionID", "TransactionDT",
    "tx_hour", "tx_day_of_week", "tx_day", "tx_week",
)

DEVICE_TYPE_RISK = {"mobile": 0.4, "desktop": 0.2, "unknown": 0.6}
DEVICE_TYPE_RISK_DEFAULT = 0.5

ENSEMBLE_WEIGHTS = {"lgbm": 0.60, "graph": 0.25, "anomaly": 0.15}
RISK_THRESHOLDS = (("CRITICAL", 0.65), ("HIGH", 0.40), ("MEDIUM", 0.20))

# isolation-forest feature subset, in the reference's priority order
ANOMALY_FEATURES: tuple[str, ...] = (
    "TransactionAmt", "tx_amount_log",
    "amount_zscore", "card_amount_ratio",
    "time_since_last_tx",
    "tx_hour", "tx_is_night", "tx_is_weekend",
    "device_user_count", "device_risk_score", "device_fraud_rate",
    "card_tx_count", "card_tx_mean_amt", "card_tx_std_amt",
    "card_device_count", "card_email_count",
    "identity_mismatch_score",
    "email_domain_fraud_rate", "addr_fraud_rate",
    "card_tx_count_24h", "card_tx_count_1h",
)


@dataclass(frozen=True)
class GbtParams:
    max_iter: int = 20
    step_size: float = 0.03
    max_depth: int = 8
    subsampling_rate: float = 0.7
    feature_subset: str = "0.7"
    seed: int = 42


@dataclass(frozen=True)
class ForestParams:
    n_trees: int = 200
    max_samples: int = 256
    contamination: float = 0.002
    seed: int = 42


@dataclass(frozen=True)
class WalkParams:
    dimensions: int = 64
    walk_length: int = 20
    num_walks: int = 50
    p: float = 1.0
    q: float = 0.5
    window: int = 10
    min_count: int = 1
    seed: int = 42


@dataclass(frozen=True)
class Config:
    roles: Roles = field(default_factory=Roles)
    windows: tuple[tuple[int, str], ...] = TIME_WINDOWS
    validation_frac: float = 0.2
    gbt: GbtParams = field(default_factory=GbtParams)
    forest: ForestParams = field(default_factory=ForestParams)
    walks: WalkParams = field(default_factory=WalkParams)
    co_device_next: int = 4          # each card links to at most the next 4 cards on a device
    high_risk_levels: tuple[str, ...] = ("HIGH", "CRITICAL")


DEFAULT = Config()
