"""The 64 PII labels, their 8 groups and how each label is detected here.

Detector kinds (our own scheme; no neural model ships with this package):

* ``P``  pattern (some with a checksum)
* ``C``  keyword context, then the value (``cvv: 123``)
* ``D``  dictionary: a user-supplied term table, joined on tokens
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# --- fixed values: must equal the reference's label set and group names ---
# Group names and descriptions, in order.
GROUPS = [
    ("Personal", "Personal identity information (names, demographics)"),
    ("Contact", "Contact and location information"),
    ("Financial", "Financial and banking information"),
    ("Government", "Government-issued identifiers"),
    ("Digital/Technical", "Digital and technical identifiers"),
    ("Healthcare/PHI", "Protected Health Information (PHI)"),
    ("Temporal", "Date and time information"),
    ("Organization", "Organization and employment information"),
]

# Labels in order, with their group.
LABELS = [
    ("first_name", "Personal"),
    ("last_name", "Personal"),
    ("name", "Personal"),
    ("date_of_birth", "Personal"),
    ("age", "Personal"),
    ("gender", "Personal"),
    ("sexuality", "Personal"),
    ("race_ethnicity", "Personal"),
    ("religious_belief", "Personal"),
    ("political_view", "Personal"),
    ("occupation", "Personal"),
    ("employment_status", "Personal"),
    ("education_level", "Personal"),
    ("email", "Contact"),
    ("phone_number", "Contact"),
    ("street_address", "Contact"),
    ("city", "Contact"),
    ("county", "Contact"),
    ("state", "Contact"),
    ("country", "Contact"),
    ("coordinate", "Contact"),
    ("zip_code", "Contact"),
    ("po_box", "Contact"),
    ("credit_debit_card", "Financial"),
    ("cvv", "Financial"),
    ("bank_routing_number", "Financial"),
    ("account_number", "Financial"),
    ("iban", "Financial"),
    ("swift_bic", "Financial"),
    ("pin", "Financial"),
    ("ssn", "Financial"),
    ("tax_id", "Financial"),
    ("ein", "Financial"),
    ("passport_number", "Government"),
    ("driver_license", "Government"),
    ("license_plate", "Government"),
    ("national_id", "Government"),
    ("voter_id", "Government"),
    ("ipv4", "Digital/Technical"),
    ("ipv6", "Digital/Technical"),
    ("mac_address", "Digital/Technical"),
    ("url", "Digital/Technical"),
    ("user_name", "Digital/Technical"),
    ("password", "Digital/Technical"),
    ("device_identifier", "Digital/Technical"),
    ("imei", "Digital/Technical"),
    ("serial_number", "Digital/Technical"),
    ("api_key", "Digital/Technical"),
    ("secret_key", "Digital/Technical"),
    ("medical_record_number", "Healthcare/PHI"),
    ("health_plan_beneficiary_number", "Healthcare/PHI"),
    ("blood_type", "Healthcare/PHI"),
    ("biometric_identifier", "Healthcare/PHI"),
    ("health_condition", "Healthcare/PHI"),
    ("medication", "Healthcare/PHI"),
    ("insurance_policy_number", "Healthcare/PHI"),
    ("date", "Temporal"),
    ("time", "Temporal"),
    ("date_time", "Temporal"),
    ("company_name", "Organization"),
    ("employee_id", "Organization"),
    ("customer_id", "Organization"),
    ("certificate_license_number", "Organization"),
    ("vehicle_identifier", "Organization"),
]
# --- end of fixed values ---

DEFAULT_THRESHOLD = 0.6
ALL_LABELS = [label for label, _ in LABELS]
GROUP_OF = dict(LABELS)
GROUP_DESCRIPTION = dict(GROUPS)

# Labels that need a dictionary (or a model) in this package.
DICTIONARY_LABELS = frozenset({
    "first_name", "last_name", "name", "gender", "sexuality", "race_ethnicity",
    "religious_belief", "political_view", "occupation", "employment_status",
    "education_level", "city", "county", "state", "country", "health_condition",
    "medication", "company_name",
})


def detector_kind(label: str) -> str:
    from tableguard.functions.pii_patterns import DETECTORS

    if label in DICTIONARY_LABELS:
        return "D"
    kinds = {d.kind for d in DETECTORS if d.label == label}
    return "P" if "P" in kinds else "C"


LABEL_SCHEMA = T.StructType([
    T.StructField("label", T.StringType(), False),
    T.StructField("grp", T.StringType(), False),
    T.StructField("description", T.StringType(), False),
    T.StructField("detector", T.StringType(), False),
    T.StructField("label_no", T.IntegerType(), False),
])


def pii_labels(spark: SparkSession) -> DataFrame:
    """The label table: 64 rows, small and fixed, safe to broadcast."""
    rows = [(label, grp, GROUP_DESCRIPTION[grp], detector_kind(label), i + 1)
            for i, (label, grp) in enumerate(LABELS)]
    return spark.createDataFrame(rows, LABEL_SCHEMA)


def validate_labels(labels) -> list[str]:
    """Check a user label list against the 64 labels (driver-side, tiny)."""
    if labels is None:
        return list(ALL_LABELS)
    unknown = [x for x in labels if x not in GROUP_OF]
    if unknown:
        raise ValueError(f"unknown PII labels: {unknown}; use one of {ALL_LABELS}")
    return list(labels)
