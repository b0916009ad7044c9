"""Closed vocabularies of the domain. All of these are fixed values."""

MAPPING_STATES = ("CONFIRMED", "AMBIGUOUS", "UNRESOLVED", "NONE")
CLASSIFICATIONS = ("MATCH", "DEVIATION", "MISSING", "CONFLICT", "AMBIGUOUS", "UNRESOLVED", "UNABLE_TO_EVALUATE")
#: A finding takes the first of these that any of its evaluations has.
ROLL_UP = ("UNABLE_TO_EVALUATE", "CONFLICT", "AMBIGUOUS", "UNRESOLVED", "MISSING", "DEVIATION", "MATCH")
TIER_1 = ROLL_UP[:4]
RULE_OUTCOMES = ("ACCEPTABLE", "APPROVAL_REQUIRED", "UNACCEPTABLE", "NOT_APPLICABLE")
DECISION_TYPES = ("ACCEPT_DEVIATION", "REQUIRE_COMPANY_STANDARD", "APPROVE_CUSTOMIZATION", "REJECT", "REQUEST_CLARIFICATION")
REVIEW_STATUSES = ("DRAFT", "UPLOADED", "PROCESSING", "ANALYSIS_COMPLETE", "LEGAL_REVIEW", "RESOLVED", "CLOSED", "ANALYSIS_FAILED", "CANCELLED")
FINDING_STATUSES = ("OPEN", "DECISION_REQUIRED", "AWAITING_CLARIFICATION", "RESOLVED")
EVALUATOR_TYPES = ("NUMERIC_COMPARISON", "PRESENCE")
EVALUATION_KINDS = ("PRIMARY", "EXCEPTION")
EXTRACTION_STATUSES = ("COMPLETE", "PARTIAL", "AMBIGUOUS", "FAILED")
EVIDENCE_RELATIONS = ("PRIMARY", "SUPPORTING", "CONFLICTING")
EVIDENCE_SOURCES = ("NATIVE_TEXT", "OCR", "TABLE", "OTHER")
USER_STATUSES = ("ACTIVE", "SUSPENDED", "DISABLED")
CONTRACT_STATUSES = ("DRAFT", "ACTIVE", "SUPERSEDED")
CONFIG_STATUSES = ("DRAFT", "ACTIVE", "DEPRECATED")
RUN_STATUSES = ("STARTED", "COMPLETED", "FAILED")
DOCUMENT_TYPES = ("MSA", "NDA", "TOS", "SLA", "DPA", "AUP", "PRIVACY_POLICY", "ORDER_FORM", "AMENDMENT", "OTHER")
CAP_STATUSES = ("FINITE", "UNLIMITED", "ABSENT", "UNKNOWN")
#: Allowed moves of a review.
TRANSITIONS = (
    ("DRAFT", "UPLOADED"), ("DRAFT", "CANCELLED"), ("UPLOADED", "PROCESSING"), ("UPLOADED", "CANCELLED"),
    ("PROCESSING", "ANALYSIS_COMPLETE"), ("PROCESSING", "ANALYSIS_FAILED"), ("ANALYSIS_COMPLETE", "LEGAL_REVIEW"),
    ("ANALYSIS_COMPLETE", "RESOLVED"), ("LEGAL_REVIEW", "RESOLVED"), ("RESOLVED", "CLOSED"),
)
DEFAULT_WEIGHTS = {"exact_phrase": 5, "alias": 3, "keyword_group": 3, "section_heading": 2, "negative_pattern": -5}
#: Fields of an evaluation that state an internal legal position.
LEGAL_POSITION_FIELDS = ("rule_outcome", "expected_value", "operator", "comparison", "explanation", "rule_configuration", "legal_rule_version_id")
#: Keys that never enter a log line.
SECRET_KEYS = (
    "password", "new_password", "current_password", "credential", "credential_hash", "secret", "client_secret", "token", "access_token", "refresh_token", "id_token",
    "bearer", "authorization", "cookie", "set-cookie", "csrf", "csrf_token", "session", "session_id", "sessionid", "code", "authorization_code", "state", "nonce", "api_key", "apikey", "private_key",
)
CONTENT_KEYS = ("content", "original_content", "clause", "clause_text", "text", "body", "paragraph", "evidence_content", "extract", "document_text", "snippet", "justification", "reason", "before_state", "after_state")
ENUMERATION_KEYS = ("email", "username", "user_email", "account")
POSITION_KEYS = (*LEGAL_POSITION_FIELDS, "threshold", "thresholds", "acceptable_max", "approval_required_above", "company_standard", "legal_rule", "preferred", "cap_value", "expected")
FORBIDDEN_KEYS = (*SECRET_KEYS, *CONTENT_KEYS, *ENUMERATION_KEYS, *POSITION_KEYS)
#: Words that make a key secret wherever they stand in it, and keys that are forbidden only as a whole.
SECRET_WORDS = ("password", "secret", "credential", "token", "apikey", "passphrase")
EXACT_ONLY_KEYS = ("state", "code", "nonce")
MAX_LOGGED = 200
#: Lines of a traceback and causes of an error that are logged.
TRACEBACK_LINES, CAUSES = 25, 3
PAYLOAD_MARKERS = ("DETAIL:", "[SQL:", "[parameters:", "Failing row contains")
#: Requests of one key within a window, in seconds.
RATE_LIMITS = {"LOGIN": (10, 300), "ANALYSIS": (30, 3600), "EXPORT": (20, 3600)}
