"""Explicit schemas of the tables users land and keep."""

EVENTS = ("latitude double, longitude double, bright_ti4 double, bright_ti5 double, frp double, "
          "acq_date date, acq_time int, satellite string, confidence string, daynight string")
EVENT_KEY = ("latitude", "longitude", "acq_date", "acq_time", "satellite")
SIDE = ("date date, state string, district string, T2M double, RH2M double, WS2M double, "
        "PRECTOTCORR double")
SIDE_VALUES = ("T2M", "RH2M", "WS2M", "PRECTOTCORR")
PREDICTIONS = ("prediction_date date, region string, entity string, risk_probability double, "
               "risk_label string")
PREDICTION_KEY = ("prediction_date", "region", "entity")
COVERAGE = ("date string, region string, entity string, observation_status string, "
            "source string, evidence_file string")
# The states of a coverage row.
COVERAGE_STATES = ("OBSERVED", "NOT_OBSERVED", "UNKNOWN")
