"""Search patterns, suffixes and thresholds that results depend on.

Patterns are given in Java syntax. ``(?U)`` makes ``\\w \\d \\s \\b`` Unicode-aware.
"""

# Fixed values -------------------------------------------------------------------
CODE_SUFFIXES = (".py", ".js")
LANGUAGE_JS_FUNCTION = r"(?U)\bfunction\s+\w+\s*\("
LANGUAGE_JS_LITERALS = ("fetch(", "XMLHttpRequest")
LANGUAGE_PY_FUNCTION = r"(?U)\bdef\s+\w+\s*\("
LANGUAGE_PY_LITERAL = "import "

JS_ASYNC_FUNCTION = r"(?U)async\s+function\s+(\w+)\s*\(([^)]*)\)"
JS_PLAIN_FUNCTION = r"(?U)(?<!async\s)function\s+(\w+)\s*\(([^)]*)\)"
JS_ARROW_FUNCTION = (
    r"(?U)(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s*)?(?:\(([^)]*)\)|([^=>\s]+))\s*=>"
)
PY_FUNCTION = r"(?U)def\s+(\w+)\s*\(([^)]*)\):"

# Arguments end at the first closing parenthesis, nested calls or not.
PY_REQUEST_CALL = r"(?U)requests\.(\w+)\s*\(([^)]*)\)"
PY_URL = r"""['"](https?://[^'"]+)['"]"""
PY_FORMATTED_URL = r"""f['"]([^'"]*)['"]"""
PY_TIMEOUT = r"(?U)timeout\s*=\s*(\d+)"
JS_FETCH_CALL = r"""(?U)fetch\s*\(\s*["'`]([^"'`]+)["'`]\s*,\s*\{([^}]+)\}"""
JS_METHOD = r"""(?U)method\s*:\s*["'`]([^"'`]+)["'`]"""
JS_TIMEOUT = r"(?U)timeout\s*:\s*(\d+)"

OPPORTUNITY_CALL = r"(?U)requests\.\w+\s*\("
OPPORTUNITY_TIMEOUT = r"(?U)timeout=\d+"
OPPORTUNITY_PAYLOAD = r"data=json\.dumps\("

# Digits below 100, leading zeros dropped, not already scaled.
REWRITE_TIMEOUT = (r"(?U)timeout=0*(\d{1,2})(?!\d)(?!\s*\*\s*1000)", "timeout=$1*1000")
REWRITE_PAYLOAD = (r"data=json\.dumps\(([^)]+)\)", "json=$1")
REWRITE_SELF_TIMEOUT = (r"(?U)(self\.timeout\s*=\s*timeout)(?!\s*\*\s*1000)", "$1 * 1000")
REWRITE_DATA_KEYWORD = (r"(?U)(requests\.(?:post|put)\([^,]+),\s*data=", "$1, json=")

CHANGE_TYPES = (
    "signature_changed", "parameter_added", "parameter_removed", "parameter_type_changed",
    "return_type_changed", "function_added", "function_removed",
)
STATUSES = ("pending", "in_progress", "completed", "failed", "rolled_back")
RULE_TYPES = ("parameter_scale", "parameter_rename", "method_replace", "type_convert")
ROLLBACK_STRATEGIES = (
    "full_rollback", "partial_rollback", "manual_verification", "selective_rollback",
)

PROFILE_SKIPPED_NODES = ("Load", "Store", "alias", "Name")
CONTROL_FLOW_NODES = ("If", "For", "While", "Try")
UNCHECKED_NAMES = ("__init__", "main")

RENAME_THRESHOLD = 0.4
NAME_WEIGHT = 0.4
STRUCTURE_WEIGHT = 0.6
SIGNATURE_CHANGE_CONFIDENCE = 0.9
VERIFIED_CONFIDENCE = 0.5
ENTITY_COMPLEXITY = 10
PARAMETER_TOLERANCE = 2
# Sentences of evidence records, differences and comparisons; braces are filled in.
PROOF_SENTENCE = (
    "Transformation '{name}' preserves behavioral semantics with confidence {confidence:.2f}"
)
CHANGE_SENTENCE = "Apply {name}"
GUARANTEE_SENTENCE = (
    "All {} transformation(s) preserve behavioral semantics with average confidence {}"
)
SIGNATURE_SENTENCE = "Signature of {} changed"
RENAME_SENTENCE = "Signature of {} changed (renamed to {})"
ADDED_SENTENCE = "Function {} was added"
REMOVED_SENTENCE = "Function {} was removed"
OUTCOMES_MATCH = "Test success status matches"
OUTCOMES_DIFFER = "Test success status differs"
DEFAULT_CHANGE = ("api_migration", "Migrate API calls to new version")
# --------------------------------------------------------------------------------
