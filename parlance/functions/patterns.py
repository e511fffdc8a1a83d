"""Fixed values of redaction and triggering: patterns, placeholders, key rules, keywords."""

from __future__ import annotations

#: ASCII word boundary; Java's own takes accented letters as word characters.
B = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"

#: Id, pattern (with \b for the ASCII boundary), case-insensitive, placeholder, category; in the order in which they apply.
INLINE = [
    ("api-key-openai", r"sk-[A-Za-z0-9]{20,}", False, "[API_KEY:OPENAI]", "api_key"),
    ("github-token", r"gh[pousr]_[A-Za-z0-9]{20,}", False, "[TOKEN:GITHUB]", "api_key"),
    ("aws-access-key", r"\bAKIA[0-9A-Z]{16}\b", False, "[ACCESS_KEY:AWS]", "api_key"),
    ("bearer-inline", r"\bBearer\s+[A-Za-z0-9._~+/=-]{8,}\b", True, "[AUTH_HEADER:BEARER]", "auth_header"),
    ("email-inline", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", False, "[EMAIL]", "email"),
    ("phone-inline", r"\b(?:\+?\d{1,3}[ -]?)?(?:\d[ -]?){6,14}\d\b", False, "[PHONE]", "phone"),
    ("sensitive-path", r"(?:^|[\\/])(?:auth|credentials|\.env)(?:[\\/]|\z)", True, "[SENSITIVE_PATH]", "sensitive_path"),
]

#: What a key says of its value, the first that matches; pattern (case-insensitive), placeholder, category, id.
KEYS = [
    (r"^openai[_-]?api[_-]?key\z", "[API_KEY:OPENAI]", "api_key", "key:openai"),
    (r"^anthropic[_-]?api[_-]?key\z", "[API_KEY:ANTHROPIC]", "api_key", "key:anthropic"),
    (r"^deepseek[_-]?api[_-]?key\z", "[API_KEY:DEEPSEEK]", "api_key", "key:deepseek"),
    (r"^github[_-]?token\z", "[TOKEN:GITHUB]", "api_key", "key:github-token"),
    (r"api[_-]?key", "[API_KEY]", "api_key", "key:api-key"),
    (r"(access[_-]?token|auth[_-]?token|token)\z", "[TOKEN]", "token", "key:token"),
    (r"secret", "[SECRET]", "token", "key:secret"),
    (r"(sessionid|session_id|sid|session)", "[SESSION_ID]", "session", "key:session"),
    (r"cookie|csrf", "[COOKIE]", "cookie", "key:cookie"),
    (r"(password|passwd|pwd|passphrase)", "[PASSWORD]", "password", "key:password"),
    (r"email", "[EMAIL]", "email", "key:email"),
    (r"(phone|mobile|tel)", "[PHONE]", "phone", "key:phone"),
    (r"authorization", "[AUTH_HEADER]", "auth_header", "key:authorization"),
]

#: Keys that describe a record and are never taken as secret.
STRUCTURAL = ("session_id", "message_id", "id", "timestamp", "captured_at", "capture_trigger", "aic_version", "provider", "role", "cwd", "worktree", "repo", "branch", "commit", "type", "name", "filename", "mime")

#: Categories that make a text high risk, and medium.
HIGH_RISK = ("api_key", "auth_header", "password", "token", "session", "cookie")
MEDIUM_RISK = ("email", "phone")

#: Assignments, URL parameters and quoted pairs.
INLINE_ASSIGNMENT = r"\b([A-Za-z0-9_.-]{3,30})\s*=\s*([^\s;&]+)"
URL_PARAM = r"(?i)([?&])(token|api[_-]?key|access_token|sessionid?|sid|auth|code|password|secret|email|phone)=([^&#\s]+)"
JSON_PAIR = r'"([A-Za-z0-9_.-]{3,50})"\s*:\s*"([^"]+)"'
KV_LINE = r"(?m)^(\s*export\s+)?([A-Za-z0-9_.-]+)\s*[:=]\s*([^\s#]+)(.*)$"
COOKIES = r"(?i)(Set-Cookie|Cookie):\s*([^\r\n]+)"

#: Every key of KEYS holds one of these, so a text without any has no sensitive key.
SENSITIVE = r"(?i)key|token|secret|sid|session|cookie|csrf|passw|pwd|passphrase|email|phone|mobile|tel|authorization"

#: Trigger words and prefixes.
SEVERITY = ("fatal", "timeout", "denied", "rollback")
SEMANTIC = ("值得提", "issue", "模板", "template", "后续可抽象", "abstract")
MANUAL = ("manual.", "manual/", "force.intel", "trigger.intel")

ISSUE_KINDS = ("bug", "feature", "docs", "refactor", "chore")


def java(pattern: str, ignore_case: bool = False) -> str:
    return ("(?i)" if ignore_case else "") + pattern.replace(r"\b", B)


def re2(pattern: str, ignore_case: bool = False) -> str:
    return ("(?i)" if ignore_case else "") + pattern


def quoted(text: str) -> str:
    """A SQL string literal for DuckDB."""
    return "'" + text.replace("'", "''") + "'"
