"""Names, texts, thresholds and lookup tables that results must equal exactly."""

# Feature order of the risk table.
CATEGORICAL = [
    "type",
    "status",
    "classification",
    "risk_class",
    "country_event",
    "country_device",
    "implanted",
    "name_manufacturer",
]
NUMERICAL = [
    "quantity_in_commerce",
    "event_count",
    "manufacturer_event_count",
    "event_year",
    "event_month",
]
FEATURES = CATEGORICAL + NUMERICAL

# Labels shown with the provenance of a feature.
PROVENANCE_LABELS = {
    "type": "Event / Alert Type",
    "status": "Action / Regulatory Status",
    "classification": "Device Classification",
    "risk_class": "Risk Class",
    "country_event": "Country of Event",
    "country_device": "Country of Device Origin",
    "implanted": "Implant Status",
    "name_manufacturer": "Manufacturer",
    "quantity_in_commerce": "Commercial Distribution Volume",
    "event_count": "Historical Device Event Count",
    "manufacturer_event_count": "Manufacturer Event Count",
    "event_year": "Event Year",
    "event_month": "Event Month",
}

# Labels shown in explanations; some differ from the provenance labels.
EXPLANATION_LABELS = {
    "type": "Event / Alert Type",
    "status": "Regulatory / Action Status",
    "classification": "Device Classification",
    "risk_class": "FDA Risk Classification",
    "country_event": "Event Location Country",
    "country_device": "Device Market Origin",
    "implanted": "Surgical Implant Status",
    "name_manufacturer": "Device Manufacturer",
    "quantity_in_commerce": "Commercial Distribution Volume",
    "event_count": "Historical Device Event Count",
    "manufacturer_event_count": "Manufacturer Historical Event Count",
    "event_year": "Event Year",
    "event_month": "Event Month",
}

# Order in which the rule weights list their features; it breaks ties in the top five.
RULE_ORDER = [
    "risk_class",
    "event_count",
    "manufacturer_event_count",
    "implanted",
    "classification",
    "type",
    "quantity_in_commerce",
    "status",
    "country_event",
    "country_device",
    "name_manufacturer",
    "event_year",
    "event_month",
]

# Rule weights: what a feature counts if its test holds, and if not; features without a test count the same always.
RULE_WEIGHTS = {
    "risk_class": (0.35, 0.1),
    "event_count": (0.30, 0.05),
    "manufacturer_event_count": (0.25, 0.05),
    "implanted": (0.20, -0.05),
    "classification": (0.15, 0.02),
    "type": (0.15, 0.01),
    "quantity_in_commerce": (0.05, 0.01),
    "status": (0.05, 0.05),
    "country_event": (0.02, 0.02),
    "country_device": (0.02, 0.02),
    "name_manufacturer": (0.05, 0.05),
    "event_year": (0.01, 0.01),
    "event_month": (0.01, 0.01),
}

# The tests' values.
RULE_RISK_CLASSES = ["3", "III", "Class 3"]
RULE_EVENTS = 5
RULE_MANUFACTURER_EVENTS = 50
RULE_IMPLANTED = "YES"
RULE_CLASSIFICATIONS = ["Cardiovascular", "Anesthesiology"]
RULE_TYPE = "Recall"
RULE_QUANTITY = 10000

# Class tokens of the two training targets.
TARGET_V1_LOW = ["CLASSI", "CLASS1", "I", "1"]
TARGET_V1_HIGH = ["CLASSII", "CLASS2", "II", "2", "CLASSIII", "CLASS3", "III", "3"]
TARGET_V2_LOW = ["CLASS1", "CLASSI", "I", "1", "CLASS2", "CLASSII", "II", "2"]
TARGET_V2_HIGH = ["CLASS3", "CLASSIII", "III", "3", "VOLUNTARYRECALL"]

# Option lists of the assessment form.
STANDARD_STATUSES = [
    "Completed",
    "Firm initiated action",
    "Not yet classified",
    "Open, Classified",
    "Terminated",
    "Classified",
]
IMPLANT_OPTIONS = ["NO", "YES"]

# Bounds and defaults.
YEAR_MIN, YEAR_MAX = 1980, 2035
MONTH_MIN, MONTH_MAX = 1, 12
MANUFACTURER_CAP = 50
CLASS_DEVICE_CAP = 200
DEFAULT_CLASSIFICATION = "Cardiovascular Devices"
DEFAULT_RISK_CLASS = "2"
DEFAULT_TYPE = "Recall"
DEFAULT_STATUS = "Completed"
DEFAULT_COUNTRY = "USA"
DEFAULT_QUANTITY = 10000.0
DEFAULT_YEAR = 2025
DEFAULT_MONTH = 6

# Provenance sources.
SRC_USER_SELECTION = "User selection"
SRC_USER_PROVIDED = "User provided"
SRC_HISTORY = "Historical dataset"
SRC_NO_RECORDS = "No records"
SRC_DEVICE = "Matched device record"
SRC_CATALOG = "Dataset catalog baseline"
SRC_MARKET = "Dataset market baseline"
SRC_INCIDENT = "Dataset incident baseline"
SRC_VOLUME = "Catalog volume baseline"
SRC_EVENT_RECORD = "Historical event record"
SRC_RECORDED = "Recorded evaluation"

# Rejection messages.
MSG_MISSING = "Additional information is required before this assessment can be performed: "
MSG_MISSING_IMPLANT = "Implant Status (implanted)"
MSG_MISSING_MANUFACTURER = "Manufacturer (name_manufacturer)"
MSG_NEGATIVE = " must be non-negative."
MSG_YEAR = "event_year must be between 1980 and 2035."
MSG_MONTH = "event_month must be between 1 and 12."

# Trend bands and texts.
TREND_STABLE_MAX = 0.15
TREND_INCREASING_MAX = 0.75
TREND_STABLE = "Stable"
TREND_INCREASING = "Increasing"
TREND_RAPID = "Rapidly Increasing"
TREND_DIRECTION = {TREND_STABLE: "stable", TREND_INCREASING: "up", TREND_RAPID: "up_rapid"}
TREND_TEXT = {
    TREND_STABLE: "Historical event activity has remained relatively consistent.",
    TREND_INCREASING: "Historical event activity shows a gradual upward trend.",
    TREND_RAPID: "Historical event activity has increased significantly in recent years.",
}
TREND_TEXT_SHORT = (
    "Only limited historical event data is available for this device; "
    "insufficient history to establish a clear trend."
)
TREND_TEXT_NONE = "No historical event data available for this device."
TREND_TEXT_UNDATED = (
    "This device has %d recorded historical event(s), but none include "
    "a usable event year, so a yearly trend cannot be displayed."
)
UNKNOWN_DEVICE = "Unknown Device"

# Bar names of the event volume comparison.
BAR_DEVICE = "Device Events"
BAR_MANUFACTURER = "Mfr Total Events"

# Notes of the historical counts report.
NOTE_FOUND = "Found %d historical events for '%s'."
NOTE_NONE = "No matching historical records found for the selection."

# Audit.
AUDIT_ACTION = "PREDICTION_CREATED"
AUDIT_TEXT = "Risk assessment created for %s (%s) - Result: %s (%s%%)"

# Explanation bands and texts.
IMPACT_THRESHOLD = 0.02
ELEVATED, REDUCED, NEUTRAL = "ELEVATED_RISK", "REDUCED_RISK", "NEUTRAL"
BADGES = {
    ELEVATED: "Elevated Risk Impact",
    REDUCED: "Reduced Risk Impact",
    NEUTRAL: "Neutral",
}
ELEVATED_TEXT = {
    "risk_class": "High risk regulatory classification ({}) is historically associated with severe failure impact.",
    "event_count": "Historical event count ({}) indicates repeated incident reports for this device profile.",
    "manufacturer_event_count": "High manufacturer event volume ({}) reflects elevated historical event concentration.",
    "implanted": "Implantable medical device status ({}) requires strict tolerance and carries higher failure consequences.",
    "classification": "Device clinical specialty ({}) has a higher frequency of reported adverse events.",
    "type": "Alert type '{}' is categorized under active safety monitoring.",
    "quantity_in_commerce": "Extensive commercial distribution ({} units) widens potential operational exposure.",
}
ELEVATED_OTHER = "Associated with elevated predicted risk in the historical training distribution."
REDUCED_TEXT = {
    "risk_class": "Lower risk regulatory tier ({}) corresponds with lower historical failure rates.",
    "event_count": "Low historical event frequency ({}) reflects stable operational performance.",
    "implanted": "Non-implanted configuration ({}) carries lower invasive operational risk.",
}
REDUCED_OTHER = "Associated with reduced predicted risk in the historical training distribution."
NEUTRAL_TEXT = "{} has a baseline neutral contribution in the model."

NARRATIVE_MODEL = "XGBoost"
NARRATIVE_HIGH = (
    "The trained {model} machine learning model estimated an elevated failure/risk score of {pct}% "
    "(High Risk) based on historical medical-device event patterns. "
)
NARRATIVE_HIGH_FACTORS = "Key contributing risk factors include {names}. "
NARRATIVE_HIGH_END = (
    "Historical patterns for manufacturer '{manufacturer}' and classification '{classification}' "
    "exhibit characteristics aligned with elevated maintenance attention."
)
NARRATIVE_LOW = (
    "The trained {model} machine learning model estimated a low failure/risk score of {pct}% "
    "(Low Risk) based on historical medical-device event patterns. "
)
NARRATIVE_LOW_FACTORS = "Mitigating factors such as {names} correlate with lower adverse event rates. "
NARRATIVE_LOW_END = (
    "The device characteristics for manufacturer '{manufacturer}' "
    "remain within baseline operational parameters in the historical distribution."
)

# Maintenance protocols.
PROTOCOL_HIGH_START = [
    "ACTION PROTOCOL: HIGH PRIORITY MAINTENANCE REVIEW",
    "1. Inspection Schedule: Expedite physical verification and performance testing within 24 to 48 hours.",
    "2. Maintenance History: Audit historical maintenance logs and calibration records for recurrent anomalies.",
]
PROTOCOL_HIGH_MANY_EVENTS = (
    "3. Failure Pattern Investigation: Conduct targeted diagnostics focusing on subsystems "
    "flagged in previous event history."
)
PROTOCOL_HIGH_FEW_EVENTS = (
    "3. Preventive Maintenance: Perform manufacturer-recommended preventive maintenance "
    "and sensor/battery verification."
)
PROTOCOL_HIGH_IMPLANTED = (
    "4. Critical Implant Protocol: Coordinate immediately with biomedical engineering leadership "
    "and clinical department."
)
PROTOCOL_HIGH_EXTERNAL = (
    "4. Quality Review: Check for applicable manufacturer field safety notices, safety alerts, or recall notices."
)
PROTOCOL_HIGH_END = (
    "5. Escalation: Log assessment findings into the hospital CMMS (Computerized Maintenance Management System)."
)
PROTOCOL_LOW = [
    "ACTION PROTOCOL: STANDARD PREVENTIVE MAINTENANCE",
    "1. Routine Inspection: Maintain standard periodic inspection interval as specified by the manufacturer.",
    "2. Operational Verification: Verify calibration tolerances and power/sensor baselines during standard rounds.",
    "3. Record Keeping: Log current operational hours and inspection outcome in routine maintenance records.",
    "4. Continuous Surveillance: Monitor upcoming manufacturer safety bulletins and periodic updates.",
    "5. Anomaly Escalation: If uncharacteristic sensor drift or physical wear is observed, "
    "initiate ad-hoc risk reassessment.",
]
DISCLAIMER = (
    "DISCLAIMER: This platform provides decision-support risk assessment based on historical medical-device data. "
    "It does not monitor real-time physical device telemetry, predict exact days to failure, or replace manufacturer "
    "instructions, approved hospital maintenance procedures, safety notices, recalls, or professional biomedical "
    "engineering judgment."
)
