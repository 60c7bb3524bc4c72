"""Pattern (P) and context (C) detectors for the PII labels.

Every pattern stays inside the subset that Java regex (Spark) and RE2 (DuckDB,
our oracle) read the same way: no look-around, no back-references, no ``\\b``
(Java 17 gives ``\\b`` Unicode word semantics, RE2 ASCII), no ``\\s`` (the two
disagree on vertical tab).  No pattern matches the empty string, so
``split(text, p, -1)`` has exactly one more piece than
``regexp_extract_all(text, p, 0)`` has matches.

A context detector's value is capture group 1 and is always a *suffix* of the
whole match; its span starts ``len(match) - len(value)`` characters into the
match.  Scores are our own scale: pattern 0.9, context 0.8, dictionary 0.7,
checksum pass 1.0, checksum fail 0.3 (below the 0.6 default threshold).

Values of open length have no upper bound in their pattern: a match never ends
inside a value, so no tail of a long value stays behind.  A run of name characters
before an ``@`` is only tried where it begins, so long runs cost one pass.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Detector:
    label: str
    kind: str            # "P" or "C"
    pattern: str
    group: int = 0       # 0: whole match is the span; 1: suffix value group
    check: str | None = None   # "card", "imei" or "vin"
    hints: tuple = ()          # lower-case substrings; a match needs one of them

    @property
    def score(self) -> float:
        return 0.9 if self.kind == "P" else 0.8


SCORE_CHECK_PASS = 1.0
SCORE_CHECK_FAIL = 0.3
SCORE_DICTIONARY = 0.7

_LEAD = r"(?:^|[^A-Za-z0-9_])"          # keyword must not follow a word character
_SEP = r"[ \t]*(?:[:=#]|is|was)?[ \t]*[\"']?"      # optional separator
_SEP_STRICT = r"[ \t]*[:=][ \t]*[\"']?"           # a real ':' or '=' is needed
_NUM = r"(?:[ _-]?(?:number|num|no\.?|id|#))?"    # "account number", "acct no."


def _ctx(label: str, keywords: str, value: str, strict: bool = False,
         check: str | None = None) -> Detector:
    sep = _SEP_STRICT if strict else _SEP
    prefix = f"{_LEAD}(?:{keywords}){_NUM}{sep}"
    return Detector(label, "C", f"(?i){prefix}({value})", 1, check, _keyword_hints(keywords))


def _keyword_hints(keywords: str) -> tuple:
    """Literal lower-case prefix of every top-level keyword alternative.

    Each match of a context pattern contains one of its keywords, so a text
    without any of these substrings cannot match; an empty prefix disables the
    shortcut for the detector.
    """
    alts, depth, cur = [], 0, ""
    for ch in keywords:
        if ch == "|" and depth == 0:
            alts.append(cur)
            cur = ""
            continue
        depth += ch == "("
        depth -= ch == ")"
        cur += ch
    alts.append(cur)
    hints = []
    for alt in alts:
        lit = ""
        for ch in alt:
            if ch in "[(\\?*+{.|":
                if ch in "?*{":
                    lit = lit[:-1]
                break
            lit += ch
        # a hint must not end in a non-word character: the combined keyword
        # scan would consume it and hide a keyword that uses it as its lead
        lit = lit.lower()
        while lit and not (lit[-1].isascii() and (lit[-1].isalnum() or lit[-1] == "_")):
            lit = lit[:-1]
        if not lit:
            return ()
        hints.append(lit)
    return tuple(hints)


_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_HEX = r"[0-9A-Fa-f]"
_DATE_ISO = r"[0-9]{4}-[0-1][0-9]-[0-3][0-9]"
_DATE_SLASH = r"[0-3]?[0-9]/[0-3]?[0-9]/(?:[0-9]{4}|[0-9]{2})"
_TIME = r"[0-2]?[0-9]:[0-5][0-9](?::[0-5][0-9])?"

# The listing order of spans.
DETECTORS: list[Detector] = [
    Detector("url", "P", r"(?:https?|ftp)://[^ \t\r\n<>\"'`]+", hints=("://",)),
    Detector("email", "P", r"(?:^|[^A-Za-z0-9._%+-])([A-Za-z0-9._%+-]+@[A-Za-z0-9-][A-Za-z0-9.-]*\.[A-Za-z]{2,})", 1, hints=("@",)),
    Detector("date_time", "P", _DATE_ISO + r"[T ]" + _TIME + r"(?:\.[0-9]+)?(?:Z|[+-][0-9]{2}:?[0-9]{2})?", hints=(":",)),
    Detector("iban", "P", r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?"),
    Detector("credit_debit_card", "P",
             r"[0-9]{4}(?:[ -][0-9]{4}){3}(?:[ -][0-9]{1,3})?|[0-9]{13,}", 0, "card"),
    Detector("ipv6", "P", f"(?:{_HEX}{{1,4}}:){{7}}{_HEX}{{1,4}}|(?:{_HEX}{{1,4}}:){{1,6}}:(?:{_HEX}{{1,4}}:){{0,5}}{_HEX}{{1,4}}", hints=(":",)),
    Detector("mac_address", "P", f"{_HEX}{{2}}(?:[:-]{_HEX}{{2}}){{5}}"),
    Detector("ipv4", "P", f"(?:{_OCTET}\\.){{3}}{_OCTET}"),
    Detector("phone_number", "P",
             r"(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\)|[0-9]{3})[ .-]?[0-9]{3}[ .-][0-9]{4}"),
    Detector("ssn", "P", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", hints=("-",)),
    Detector("street_address", "P",
             r"[0-9]{1,5}(?: [A-Z][a-z]+){1,3} (?:Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd"
             r"|Lane|Ln|Drive|Dr|Court|Ct|Way|Place|Pl|Terrace|Square|Sq)\.?"),
    Detector("po_box", "P", r"(?i)P\.? ?O\.? ?Box [0-9]+", hints=("box",)),
    Detector("coordinate", "P", r"[+-]?[0-9]{1,2}\.[0-9]{4,}, ?[+-]?[0-9]{1,3}\.[0-9]{4,}"),
    Detector("vehicle_identifier", "P", r"[A-HJ-NPR-Z0-9]{17,}", 0, "vin"),
    Detector("api_key", "P", r"AKIA[0-9A-Z]{16,}|gh[pousr]_[A-Za-z0-9]{36,}|sk-[A-Za-z0-9]{32,}",
             hints=("akia", "_", "sk-")),
    # context detectors: keyword, optional separator, value
    _ctx("secret_key", r"secret|secret[_ -]?key|client[_ -]?secret|token|auth[_ -]?token"
         r"|access[_ -]?token|private[_ -]?key", r"[A-Za-z0-9_/+.-]{16,}", strict=True),
    _ctx("api_key", r"api[_ -]?key|apikey|access[_ -]?key", r"[A-Za-z0-9_/+.-]{16,}", strict=True),
    _ctx("password", r"password|passwd|pwd", r"[^ \t\r\n\"']{4,}", strict=True),
    _ctx("user_name", r"username|user[_ -]name|login|user", r"[A-Za-z0-9._@-]{3,}", strict=True),
    _ctx("date_of_birth", r"date of birth|birth ?date|dob|born on", f"{_DATE_ISO}|{_DATE_SLASH}"),
    _ctx("age", r"age|aged", r"[0-9]+"),
    _ctx("cvv", r"cvv2?|cvc2?|security code", r"[0-9]{3,}"),
    _ctx("bank_routing_number", r"routing|aba|rtn", r"[0-9]{9,}"),
    _ctx("account_number", r"account|acct\.?", r"[0-9]{6,}"),
    _ctx("swift_bic", r"swift(?: code)?|bic", r"[A-Z]{6}[A-Z0-9]{2}(?:[A-Z0-9]{3})?"),
    _ctx("pin", r"pin(?: code)?", r"[0-9]{4,}"),
    _ctx("tax_id", r"tax(?: id)?|tin|itin", r"[0-9]{2,3}-?[0-9]{2}-?[0-9]{4,}"),
    _ctx("ein", r"ein|employer identification", r"[0-9]{2}-[0-9]{7,}"),
    _ctx("passport_number", r"passport", r"[A-Z0-9]{6,}"),
    _ctx("driver_license", r"driver'?s? licen[cs]e|dl", r"[A-Z0-9-]{5,}"),
    _ctx("license_plate", r"license plate|plate", r"[A-Z0-9-]{2,}"),
    _ctx("national_id", r"national id|nino|nin|identity", r"[A-Z0-9-]{5,}"),
    _ctx("voter_id", r"voter(?: id)?|voter registration", r"[A-Z0-9-]{5,}"),
    _ctx("device_identifier", r"device(?: id| identifier)?|udid|android id|idfa",
         r"[A-Za-z0-9-]{8,}", strict=True),
    _ctx("imei", r"imei", r"[0-9]{15,}", check="imei"),
    _ctx("serial_number", r"serial|s/n", r"[A-Z0-9-]{5,}"),
    _ctx("medical_record_number", r"mrn|medical record", r"[A-Z0-9-]{5,}"),
    _ctx("health_plan_beneficiary_number", r"health plan(?: beneficiary)?|beneficiary|member",
         r"[A-Z0-9-]{5,}"),
    _ctx("blood_type", r"blood (?:type|group)", r"AB[+-]|A[+-]|B[+-]|O[+-]"),
    _ctx("biometric_identifier", r"fingerprint|biometric|retina|iris scan",
         r"[A-Za-z0-9+/=-]{8,}", strict=True),
    _ctx("insurance_policy_number", r"policy|insurance", r"[A-Z0-9-]{5,}"),
    _ctx("zip_code", r"zip(?: code)?|postal code|postcode",
         r"[0-9]{5,}(?:-[0-9]{4,})?|[A-Z][0-9][A-Z] ?[0-9][A-Z][0-9]"),
    _ctx("employee_id", r"employee|emp|staff", r"[A-Z0-9-]{3,}", strict=True),
    _ctx("customer_id", r"customer|client", r"[A-Z0-9-]{3,}", strict=True),
    _ctx("certificate_license_number", r"certificate|license|licence", r"[A-Z0-9-]{4,}", strict=True),
    # plain dates and times
    Detector("date", "P", f"{_DATE_ISO}|{_DATE_SLASH}"),
    Detector("time", "P", _TIME + r"(?: ?[AaPp][Mm])?", hints=(":",)),
]

PATTERN_LABELS = sorted({d.label for d in DETECTORS})


def detectors_for(labels=None) -> list[Detector]:
    """Detectors whose label is in ``labels`` (all when None), chain order kept."""
    if labels is None:
        return list(DETECTORS)
    wanted = set(labels)
    return [d for d in DETECTORS if d.label in wanted]


def redaction_token(label: str) -> str:
    return f"[REDACTED_{label}]"
