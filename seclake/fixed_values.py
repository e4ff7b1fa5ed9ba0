"""Fixed values.

Everything in this module is data that results depend on: the rule table, weights,
cut-offs, allowed moves and fixed texts. It holds no logic.
"""

from __future__ import annotations

from typing import NamedTuple


class Rule(NamedTuple):
    vuln_id: str
    language: str
    category: str
    pattern: str
    description: str
    cwe_id: str
    owasp_category: str
    confidence: str
    severity: str


# ---- fixed values: severities, levels, lifecycle -------------------------------

SEVERITIES = ("Critical", "High", "Medium", "Low")
SEVERITY_WEIGHT = {"Critical": 10, "High": 7, "Medium": 4, "Low": 1}
SEVERITY_RANK = {"Critical": 0, "High": 1, "Medium": 2, "Low": 3}
OTHER_SEVERITY_RANK = 4
OTHER_SEVERITY_WEIGHT_OPEN = 1
SEVERITY_EMOJI = {"Critical": "🔴", "High": "🟠", "Medium": "🟡", "Low": "🟢"}
OTHER_EMOJI = "•"

LIFECYCLE = ("Safe", "Warning", "Vulnerable", "Critical", "Resolved")
ALLOWED_MOVES = {
    "Safe": ["Warning", "Resolved"],
    "Warning": ["Safe", "Vulnerable", "Resolved"],
    "Vulnerable": ["Warning", "Critical", "Resolved"],
    "Critical": ["Vulnerable", "Resolved"],
    "Resolved": [],
}
FINDING_STATUSES = ("open", "mitigated", "resolved", "fixed", "accepted")
CLOSED_STATUSES = ("fixed", "accepted")
MODES = ("paste", "upload", "github")

RISK_TREND = {
    "Critical": "🔴 Urgent Action Required — Exploitable vulnerabilities present",
    "High": "🟠 Action Required — Significant security weaknesses detected",
    "Medium": "🟡 Review Recommended — Moderate risk requiring attention",
    "Low": "🟢 Low Risk — Minor issues detected; best-practice hardening advised",
}

# ---- fixed values: languages ---------------------------------------------------

EXTENSION_LANGUAGE = {
    ".py": "python",
    ".js": "javascript",
    ".ts": "javascript",
    ".jsx": "javascript",
    ".tsx": "javascript",
    ".php": "php",
    ".java": "java",
    ".c": "c",
    ".cpp": "c",
    ".h": "c",
}
SCANNED_EXTENSIONS = (".py", ".js", ".cpp")
LANGUAGE_SNIFF_CHARS = 500
CONTEXT_LINES = 3

# Characters Python's str.strip() removes and str.splitlines() breaks on.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
LINE_BREAK = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]"
RARE_BREAKS = ("\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", "\u2028", "\u2029")

# ---- fixed values: texts -------------------------------------------------------

STATIC_RECOMMENDATION = (
    "Review the flagged line and apply secure coding best practices."
)
STATIC_EXPLOIT = "N/A"
STATIC_FALSE_POSITIVE = "MEDIUM"
STATIC_SUMMARY = "Static analysis only."

ANSWER_DEFAULTS = {
    "category": "Security Flaw",
    "line_number": 0,
    "line_content": "Review code",
    "severity": "High",
    "ai_explanation": "Potential security risk found.",
    "recommendation": "Sanitize inputs and secure secrets.",
    "executive_summary": "Audit finished.",
    "secure_code": "",
}
ANSWER_FIXED = {
    "vuln_id": "AI-VULN",
    "cwe_id": "N/A",
    "owasp_category": "N/A",
    "confidence": "High",
    "exploit_scenario": "",
    "secure_code_snippet": "",
    "false_positive_likelihood": "Low",
}
ANSWER_SCORE_WITH_FINDINGS = 70
FAILED_ANSWER_SCORE = 50
FAILED_ANSWER_LEVEL = "Warning"
NO_JSON_MESSAGE = "Analysis Error: AI response contained no valid JSON block."
BAD_JSON_MESSAGE = "Analysis Error: AI response is not valid JSON."

PROMPT_FORMAT = """Analyze this %s source code.
SOURCE: %s
CODE: %s
FINDINGS: %s

Return JSON strictly in this format:
{
  "analyzed_vulnerabilities": [],
  "additional_findings": [],
  "overall_risk_score": 0,
  "overall_risk_level": "Low",
  "executive_summary": "",
  "top_priority_fixes": [],
  "secure_code": ""
}"""

SCAN_DETAILS = "Scan completed — score %s (%s)"
REPO_DETAILS = "Repository scan completed — %s files scanned. Risk score: %s"
REPO_SUMMARY = "Repository scan completed. Scanned %s files."
SCAN_REASON = "Initial scan"
REPO_REASON = "Initial repository scan"
OVERRIDE_REASON = "Manual score override"
OVERRIDE_DETAILS = "Score manually changed from %s to %s"
MOVE_REASON = "Transition from %s to %s"
MOVE_DETAILS = "Lifecycle transitioned from %s to %s"
MOVE_REJECTED = "Transition from '%s' to '%s' is not allowed"
SCAN_MISSING = "Scan %s not found"
STATUS_REASON = "Vulnerability %s status changed: %s → %s"
STATUS_DETAILS = "Vulnerability %s changed from '%s' to '%s'. Scan score recalculated to %s."
DELETE_DETAILS = "Scan %s deleted by admin"

EVENT_OF_ACTION = {
    "scan_created": "scan_completed",
    "lifecycle_transition": "lifecycle_changed",
    "manual_score_override": "score_updated",
    "vulnerability_status_changed": "vulnerability_status_changed",
}
AUDIT_EVENT = "audit_log_created"

# ---- fixed values: paging ------------------------------------------------------

SCANS_PER_PAGE_MAX = 100
RECENT_SCANS = 10

# ---- fixed values: the rule table ----------------------------------------------

RULES = [
    Rule("SQL-001", "python", "SQL Injection",
         r'(execute|cursor\.execute)\s*\(\s*["\'].*(%s|%d|\{\w+\}|f["\'])',
         "Direct string formatting in SQL query — user input may reach the database unescaped.",
         "CWE-89", "A03:2021 - Injection", "HIGH", "Critical"),
    Rule("SQL-002", "python", "SQL Injection",
         r'(execute|cursor\.execute)\s*\(\s*f["\']',
         "f-string used inside a database execute call — vulnerable to SQL injection.",
         "CWE-89", "A03:2021 - Injection", "HIGH", "Critical"),
    Rule("CMD-001", "python", "Command Injection",
         r'os\.system\s*\(.*\+|subprocess\.(call|run|Popen)\s*\(.*\+',
         "Shell command constructed with string concatenation — command injection risk.",
         "CWE-78", "A03:2021 - Injection", "HIGH", "Critical"),
    Rule("CMD-002", "python", "Command Injection",
         r'eval\s*\(',
         "eval() executes arbitrary code — extremely dangerous with untrusted input.",
         "CWE-95", "A03:2021 - Injection", "HIGH", "Critical"),
    Rule("SEC-001", "python", "Hardcoded Credentials",
         r'(password|passwd|pwd|secret|api_key|apikey|token)\s*=\s*["\'][^"\']{4,}["\']',
         "Possible hardcoded credential or secret detected.",
         "CWE-798", "A07:2021 - Identification and Authentication Failures", "MEDIUM", "High"),
    Rule("CRYPTO-001", "python", "Weak Cryptography",
         r'(md5|sha1)\s*\(',
         "MD5/SHA-1 are cryptographically broken — use SHA-256 or stronger.",
         "CWE-327", "A02:2021 - Cryptographic Failures", "HIGH", "High"),
    Rule("CRYPTO-002", "python", "Weak Cryptography",
         r'hashlib\.(md5|sha1)\s*\(',
         "hashlib MD5/SHA-1 usage detected — upgrade to SHA-256.",
         "CWE-327", "A02:2021 - Cryptographic Failures", "HIGH", "High"),
    Rule("DESER-001", "python", "Insecure Deserialization",
         r'pickle\.(loads|load)\s*\(',
         "pickle deserialization of untrusted data can lead to remote code execution.",
         "CWE-502", "A08:2021 - Software and Data Integrity Failures", "HIGH", "Critical"),
    Rule("DESER-002", "python", "Insecure Deserialization",
         r'yaml\.load\s*\([^,)]+\)',
         "yaml.load() without Loader=yaml.SafeLoader can execute arbitrary Python.",
         "CWE-502", "A08:2021 - Software and Data Integrity Failures", "HIGH", "High"),
    Rule("PATH-001", "python", "Path Traversal",
         r'open\s*\(\s*(request\.|input\(|sys\.argv)',
         "File open with user-controlled path — path traversal vulnerability.",
         "CWE-22", "A01:2021 - Broken Access Control", "MEDIUM", "High"),
    Rule("XSS-001", "python", "Cross-Site Scripting (XSS)",
         r'(render|render_template_string)\s*\(.*request\.',
         "Rendering user input in template without escaping — XSS risk.",
         "CWE-79", "A03:2021 - Injection", "MEDIUM", "High"),
    Rule("RAND-001", "python", "Insecure Randomness",
         r'random\.(random|randint|choice|randrange)\s*\(',
         "Standard random module is not cryptographically secure — use secrets module.",
         "CWE-330", "A02:2021 - Cryptographic Failures", "MEDIUM", "Medium"),
    Rule("DBG-001", "python", "Information Disclosure",
         r'(DEBUG\s*=\s*True|app\.run\s*\(.*debug\s*=\s*True)',
         "Debug mode enabled — stack traces expose sensitive info in production.",
         "CWE-209", "A05:2021 - Security Misconfiguration", "HIGH", "Medium"),
    Rule("SSRF-001", "python", "Server-Side Request Forgery",
         r'requests\.(get|post|put|delete)\s*\(\s*(request\.|input\(|sys\.argv)',
         "HTTP request made with user-controlled URL — SSRF vulnerability.",
         "CWE-918", "A10:2021 - Server-Side Request Forgery", "MEDIUM", "High"),
    Rule("XXE-001", "python", "XML External Entity (XXE)",
         r'etree\.(parse|fromstring)\s*\(',
         "XML parsing without disabling external entities — XXE injection risk.",
         "CWE-611", "A05:2021 - Security Misconfiguration", "MEDIUM", "High"),
    Rule("JS-SQL-001", "javascript", "SQL Injection",
         r'(query|execute)\s*\(\s*["`\'].*\$\{',
         "Template literal used in DB query — SQL injection via user input.",
         "CWE-89", "A03:2021 - Injection", "HIGH", "Critical"),
    Rule("JS-XSS-001", "javascript", "Cross-Site Scripting (XSS)",
         r'innerHTML\s*=',
         "Setting innerHTML with dynamic data — XSS risk.",
         "CWE-79", "A03:2021 - Injection", "HIGH", "High"),
    Rule("JS-EVAL-001", "javascript", "Code Injection",
         r'\beval\s*\(',
         "eval() executes arbitrary code — never use with user input.",
         "CWE-95", "A03:2021 - Injection", "HIGH", "Critical"),
    Rule("JS-SEC-001", "javascript", "Hardcoded Credentials",
         r'(password|secret|apiKey|api_key|token)\s*[:=]\s*["\'][^"\']{4,}["\']',
         "Hardcoded secret found in JavaScript source.",
         "CWE-798", "A07:2021 - Identification and Authentication Failures", "MEDIUM", "High"),
    Rule("JS-PROTO-001", "javascript", "Prototype Pollution",
         r'__proto__|prototype\[',
         "Possible prototype pollution via property access.",
         "CWE-1321", "A08:2021 - Software and Data Integrity Failures", "MEDIUM", "High"),
    Rule("PHP-SQL-001", "php", "SQL Injection",
         r'mysql_query\s*\(.*\$_(GET|POST|REQUEST|COOKIE)',
         "Unsanitized superglobal used in MySQL query — SQL injection.",
         "CWE-89", "A03:2021 - Injection", "HIGH", "Critical"),
    Rule("PHP-XSS-001", "php", "Cross-Site Scripting (XSS)",
         r'echo\s+\$_(GET|POST|REQUEST|COOKIE)',
         "Direct echo of user input without htmlspecialchars() — XSS.",
         "CWE-79", "A03:2021 - Injection", "HIGH", "High"),
    Rule("PHP-CMD-001", "php", "Command Injection",
         r'(system|exec|shell_exec|passthru)\s*\(.*\$_(GET|POST|REQUEST)',
         "Shell command with user-supplied input — command injection.",
         "CWE-78", "A03:2021 - Injection", "HIGH", "Critical"),
    Rule("JAVA-SQL-001", "java", "SQL Injection",
         r'createQuery\s*\(\s*".*"\s*\+',
         "String concatenation in JPA/JDBC query — SQL injection risk.",
         "CWE-89", "A03:2021 - Injection", "HIGH", "Critical"),
    Rule("JAVA-XXE-001", "java", "XML External Entity (XXE)",
         r'DocumentBuilderFactory\.newInstance\(\)',
         "DocumentBuilderFactory without disabling external entities — XXE.",
         "CWE-611", "A05:2021 - Security Misconfiguration", "MEDIUM", "High"),
    Rule("JAVA-DESER-001", "java", "Insecure Deserialization",
         r'ObjectInputStream\s*\(',
         "Java ObjectInputStream — deserialization of untrusted data is dangerous.",
         "CWE-502", "A08:2021 - Software and Data Integrity Failures", "MEDIUM", "Critical"),
]

# Rules found from the order of lines instead of from one pattern.
ASSERT_RULE = Rule(
    "PY-AST-001", "python", "Assert Used for Security", "",
    "assert statements are removed with python -O; "
    "do not use for authentication or access control.",
    "CWE-617", "A07:2021 - Identification and Authentication Failures", "HIGH", "Medium")
SILENT_EXCEPT_RULE = Rule(
    "PY-AST-002", "python", "Silent Exception Handling", "",
    "Bare 'except: pass' silently swallows all exceptions, "
    "masking security-relevant errors.",
    "CWE-390", "A09:2021 - Security Logging and Monitoring Failures", "MEDIUM", "Low")
STRUCTURAL_RULES = [ASSERT_RULE, SILENT_EXCEPT_RULE]
