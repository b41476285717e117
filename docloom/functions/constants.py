
#: White space as Python's str.split sees it, in a form that Java and RE2 read alike.
SPACE = r"[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

#: The same but for the plain blank.
SPACE_BUT_BLANK = SPACE.replace(r"\x{1c}-\x{20}", r"\x{1c}-\x{1f}")

# markup
HEADING_TAGS = ("h1", "h2", "h3", "h4")
TEXT_TAGS = ("p", "li", "pre", "code")
DROP_TAGS = ("script", "style", "noscript", "svg", "header", "footer", "nav", "form")
META_UPDATED_KEYS = ("article:modified_time", "og:updated_time", "last-modified", "date", "dc.date.modified")

# Patterns of low-signal text
LOW_SIGNAL_HEADING = r"(?i)\b(feedback|page status|what'?s next|references|contributors|survey)\b"
LOW_SIGNAL_TEXT = (
    r"(?i)(was this page helpful\?|thanks for the feedback|open an issue in the github repository|ask it on stack overflow|"
    r"have feedback for us|changes since first version|learning from first version|raw data and feedback of the survey)"
)
LOW_SIGNAL_SECTION = r"(?i)\b(references|what'?s next|what s next|table of contents|contents|contributors|survey)\b"
REPORT_HEADER = r"(?i)u/oo/168286|pp-22-0324|august 2022 ver"
AGENCY = r"(?i)national security agency|cybersecurity and infrastructure security agency|kubernetes hardening guid"
DOT_LEADER = r"\.{3,}"
PAGE_ONLY = r"(?i)^[ivxlcdm0-9]+$"
PUNCT_ONLY = r"^[^\w]+$"
PAGE_REFERENCE = r",\s*\d{1,3}(?:-\d{1,3})?\b"
REFERENCES = r"(?i)\b(references|bibliography)\b"
COLOPHON = r"(?i)\b(about the author|colophon|acknowledg?ments?)\b"
ABBREVIATIONS = r"(?i)\b(symbols and abbreviations|abbreviations)\b"
THESIS_FRONT_MATTER = r"(?i)\b(master'?s thesis|licensed under a creative commons|preface)\b"
BOOK_BACK_MATTER = (
    r"(?i)\b(other books you may enjoy|leave a review|about the reviewers|contributors|about the authors|have feedback for us|"
    r"changes since first version|learning from first version|raw data and feedback of the survey)\b"
)
PUBLISHER_FRONT_MATTER = r"(?i)\b(packt\.com subscribe|first published:|published by packt publishing|foreword)\b"
VENDOR_MARKETING = r"(?i)\b(about red hat|redhat\.com|red hat openshift provides a full featured technology stack)\b"
BACK_MATTER = (
    r"(?i)\b(about the author|colophon|acknowledg?ments?|have feedback for us|changes since first version|"
    r"learning from first version|raw data and feedback of the survey)\b"
)
#: Of which one must be there for the pattern of back matter to be.
BACK_MATTER_PARTS = ("about the author", "colophon", "acknowledg", "have feedback for us", "changes since first version", "learning from first version", "raw data and feedback of the survey")
URL = r"(?i)https?://|www\."
SENTENCE_START = "[A-Z0-9(\"']"

# limits
MIN_SECTION_CHARS, MIN_PAGE_CHARS, MIN_FEED_CHARS = 40, 80, 40
ENRICH_BELOW_WORDS = 45
MIN_PROXY_SENTENCE = 25
CONTEXT_THRESHOLD, FAITHFUL_THRESHOLD = 0.38, 0.42
TOPIC_HIT_BONUS, TOPIC_BONUS_CAP, TOPIC_WINDOW = 0.01, 0.03, 800

# Sources treated as official
OFFICIAL_SOURCES = (
    "k8s_security_docs", "k8s_access_control_docs", "k8s_operational_security_docs", "k8s_cve_feed",
    "nsa_cisa_k8s_hardening", "nist_sp_800_190", "owasp_k8s_cheatsheet",
)

# Keywords of each topic
TOPIC_KEYWORDS = {
    "authentication_and_identity": ("authentication", "identity", "oidc", "tls", "certificate", "api server"),
    "rbac_and_service_accounts": ("rbac", "role", "rolebinding", "service account", "least privilege", "tokenreview"),
    "pod_security_and_admission_control": ("pod security", "admission", "restricted", "privileged", "capabilities", "hostpath"),
    "secrets_handling": ("secret", "encryption at rest", "plaintext", "kms", "sealed secret", "external secret"),
    "network_policy_and_traffic_isolation": ("networkpolicy", "ingress", "egress", "default deny", "traffic isolation", "namespace selector"),
    "etcd_and_data_protection": ("etcd", "encryption at rest", "backup", "confidential data", "key management", "data protection"),
    "image_and_supply_chain_security": ("image", "digest", "signing", "sbom", "supply chain", "vulnerability scan"),
    "logging_auditing_and_detection": ("audit log", "logging", "detection", "siem", "event", "forensics"),
    "multi_tenancy_and_isolation": ("multi tenancy", "tenant isolation", "namespace", "node isolation", "workload separation", "sandbox"),
    "vulnerability_management_and_incident_response": ("vulnerability", "incident response", "inventory", "triage", "patching", "containment"),
}

# Difficulties of a topic's ten questions
DIFFICULTY_PATTERN = ("basic", "basic", "basic", "intermediate", "intermediate", "intermediate", "intermediate", "intermediate", "advanced", "advanced")

# prompt
QUERY_PREFIX = "Kubernetes security hardening question."
SYSTEM_PROMPT = (
    "You are a cybersecurity assistant focused on Kubernetes security hardening. "
    "Use only the retrieved context. If the context is incomplete, say that the context is incomplete. "
    "Write concise practitioner-style guidance. "
    "The final line of the answer must be a citation list in square brackets."
)
OUTPUT_REQUIREMENTS = (
    "- Answer only from the retrieved context.\n"
    "- If the retrieved context is incomplete, say that clearly.\n"
    "- Keep the answer concise and practitioner-focused.\n"
    "- The final line must be exactly one bracketed citation list using only the allowed chunk IDs.\n"
    "- Example final line: [chunk_id_1, chunk_id_2]"
)

# variants
VARIANTS = (
    ("V1", "baseline", "small"), ("V2", "improved", "small"), ("V3", "intent_enriched", "small"),
    ("V4", "baseline", "strong"), ("V5", "improved", "strong"), ("V6", "intent_enriched", "strong"),
)
