"""Word lists, tables and patterns whose content defines results."""

from __future__ import annotations

# ---------------------------------------------------------------- fixed values
# English function words that are dropped from query terms and chunk tokens.
STOP_WORDS = [
    "the", "and", "but", "for", "with", "from", "into", "this", "that", "these", "those", "when", "then", "than", "what", "which",
    "whose", "how", "why", "who", "where", "after", "before", "during", "while", "has", "have", "had", "was", "were", "are",
    "been", "being", "can", "could", "should", "would", "might", "must", "shall", "not", "nor", "yet", "either", "neither",
    "both", "all", "any", "some", "such", "very", "much", "many", "more", "most", "less", "least", "few", "several", "fewer",
    "fewest", "about", "above", "across", "against", "along", "among", "around", "because", "behind", "below", "beneath",
    "beside", "between", "down", "except", "inside", "near", "off", "outside", "over", "past", "through", "throughout", "toward",
    "under", "underneath", "until", "upon", "within", "without", "you", "your", "yours", "their", "theirs", "its", "our", "ours",
    "his", "her", "hers", "him", "them", "they", "she", "get", "got", "let", "try", "make", "made", "did", "done", "see", "seen",
    "say", "said", "tell", "told", "ask", "asked", "put", "set", "ran", "gone", "come", "came", "look", "took", "take", "taken",
    "give", "gave", "given", "find", "found", "know", "knew", "known", "think", "thought", "feel", "felt", "want", "wanted",
    "use", "used", "using", "uses", "also", "just", "only", "each", "every", "other", "another", "here", "there", "now", "too",
    "own", "same", "well", "back", "even", "still", "already", "always", "never", "often",
]

# The stop list of symbol mining: shorter words are listed too, the adverbs are not.
SYMBOL_STOP_WORDS = [
    "the", "and", "but", "for", "with", "from", "into", "this", "that", "these", "those", "when", "then", "than", "what", "which",
    "whose", "how", "why", "who", "where", "after", "before", "during", "while", "has", "have", "had", "was", "were", "are",
    "been", "being", "can", "could", "should", "would", "might", "must", "shall", "not", "nor", "yet", "either", "neither",
    "both", "all", "any", "some", "such", "very", "much", "many", "more", "most", "less", "least", "few", "several", "fewer",
    "fewest", "about", "above", "across", "against", "along", "among", "around", "at", "because", "behind", "below", "beneath",
    "beside", "between", "by", "down", "except", "in", "inside", "near", "of", "off", "on", "out", "outside", "over", "past",
    "through", "throughout", "to", "toward", "under", "underneath", "until", "up", "upon", "within", "without", "you", "your",
    "yours", "their", "theirs", "its", "our", "ours", "his", "her", "hers", "him", "them", "they", "she", "get", "got", "let",
    "try", "make", "made", "do", "did", "done", "see", "seen", "say", "said", "tell", "told", "ask", "asked", "put", "set", "run",
    "ran", "go", "went", "gone", "come", "came", "look", "took", "take", "taken", "give", "gave", "given", "find", "found",
    "know", "knew", "known", "think", "thought", "feel", "felt", "want", "wanted", "use", "used", "using", "uses",
]

# Directories a corpus scan never enters.
SCAN_EXCLUDED_DIRS = [
    ".git", "target", "build", "dist", "node_modules",
    ".idea", ".vscode", "__pycache__", ".mvn", ".gradle",
]

# File endings that are chunked and indexed; the first five are searched line by line.
LINE_SEARCH_EXTENSIONS = [".java", ".xml", ".yml", ".yaml", ".properties"]
INDEXABLE_EXTENSIONS = [".java", ".xml", ".yml", ".yaml", ".properties", ".sql", ".json", ".toml", ".gradle"]

# Issue-category aliases.
CATEGORY_ALIASES = {
    "bean_resolution": "dependency_injection",
    "bean_resolution_ambiguity": "dependency_injection",
    "dependency_injection": "dependency_injection",
    "dependency_injection_ambiguity": "dependency_injection",
    "transaction_management": "transaction",
    "transactions": "transaction",
    "configuration_properties": "configuration",
    "config": "configuration",
}

# Finite morphology of the second semantic rule version ...
MORPHOLOGY_V21 = {
    "aliases": "alias", "applications": "application", "beans": "bean",
    "conditions": "condition", "configurations": "configuration",
    "constraints": "constraint", "defaults": "default", "endpoints": "endpoint",
    "files": "file", "implementations": "implementation", "maps": "map",
    "properties": "property", "profiles": "profile", "providers": "provider",
    "relations": "relation", "senders": "sender", "settings": "setting",
    "sources": "source", "values": "value", "activates": "activate",
    "causes": "cause", "does": "do", "expects": "expect", "fails": "fail",
    "leaves": "leave", "matches": "match", "overridden": "override",
    "overrides": "override", "overriding": "override", "registered": "register",
    "requires": "require", "results": "result", "satisfies": "satisfy",
    "takes": "take", "binding": "bind", "specifies": "specify",
    "violates": "violate",
}
# ... and of the third.
MORPHOLOGY_V22 = {
    "aliases": "alias", "applications": "application", "beans": "bean", "conditions": "condition",
    "configurations": "configuration", "constraints": "constraint", "defaults": "default",
    "endpoints": "endpoint", "files": "file", "implementations": "implementation", "maps": "map",
    "properties": "property", "profiles": "profile", "providers": "provider", "relations": "relation",
    "senders": "sender", "settings": "setting", "sources": "source", "values": "value",
    "activates": "activate", "causes": "cause", "does": "do", "expects": "expect", "fails": "fail",
    "leaves": "leave", "matches": "match", "overridden": "override", "overrides": "override",
    "overriding": "override", "registered": "register", "requires": "require", "results": "result",
    "satisfies": "satisfy", "takes": "take", "binding": "bind", "specifies": "specify",
    "restricts": "restrict", "targets": "target", "configured": "configure", "conditionally": "conditional",
    "disabled": "disable",
}

# Words that make a forbidden relation a negation or a hypothesis.
NEGATION_WORDS = ["not", "never", "cannot", "fail"]
HYPOTHETICAL_WORDS = [
    "if", "would", "could", "should", "might", "may", "expected", "counterfactual",
    "after", "changing", "change", "rename", "renaming", "update", "updated",
    "correct", "corrected",
]

# Java words that are never introduced symbols.
JAVA_KEYWORDS = [
    "abstract", "assert", "boolean", "break", "byte", "case", "catch", "char", "class", "const", "continue", "default", "do",
    "double", "else", "enum", "extends", "final", "finally", "float", "for", "goto", "if", "implements", "import", "instanceof",
    "int", "interface", "long", "native", "new", "package", "private", "protected", "public", "return", "short", "static",
    "strictfp", "super", "switch", "synchronized", "this", "throw", "throws", "transient", "try", "void", "volatile", "while",
    "true", "false", "null", "record", "sealed", "permits", "non-sealed", "var", "yield",
]
JAVA_LANG_TYPES = [
    "Appendable", "AutoCloseable", "Boolean", "Byte", "CharSequence", "Character", "Class", "Cloneable", "Comparable", "Double",
    "Enum", "Error", "Exception", "Float", "IllegalArgumentException", "IllegalStateException", "IndexOutOfBoundsException",
    "Iterable", "Long", "Math", "Number", "Object", "Override", "Runnable", "RuntimeException", "SafeVarargs", "Short", "String",
    "StringBuffer", "StringBuilder", "SuppressWarnings", "System", "Thread", "Throwable", "Void", "Deprecated",
    "FunctionalInterface",
]

# Class-name prefixes of frames that never point at repository code.
FRAMEWORK_PREFIXES = [
    "java.", "javax.", "jdk.", "sun.", "com.sun.", "org.junit.", "org.apache.maven.",
    "org.springframework.", "org.gradle.", "org.mockito.",
]

# Code that an edit may never introduce: (family, pattern).
DANGEROUS_CODE = [
    ("process_execution",
     r"(?i)\bprocessbuilder\b|\bruntime\s*\.\s*(?:getruntime\s*\(\s*\)\s*\.\s*)?exec\b"),
    ("process_exit", r"(?i)\bsystem\s*\.\s*exit\b"),
    ("shell_command", r"(?i)\b(?:bash|sh|powershell|pwsh|cmd)\b|(?:^|\s)(?:curl|wget)\b"),
    ("file_deletion", r"(?i)\bfiles?\s*\.\s*(?:delete|deleteifexists)\b|\brm\s+-rf\b"),
    ("network_download", r"(?i)\b(?:download|openstream|httpurlconnection|urlconnection)\b"),
    ("credential_or_secret", r"(?i)\b(?:credential|password|secret|api[_ -]?key)\b\s*[:=]"),
    ("hardcoded_bearer", r"(?i)\bbearer\s+[A-Za-z0-9._-]{12,}"),
]

# What a test may not use to override the configuration under test.
CONFIG_OVERRIDES = [
    ".withPropertyValues(",
    ".withSystemProperties(",
    "TestPropertyValues.",
    "System.setProperty(",
    "System.getProperties().put(",
    "System.getProperties().setProperty(",
    "@ActiveProfiles(",
    "@TestPropertySource(",
    "@DynamicPropertySource",
    "DynamicPropertyRegistry",
    "SpringApplication.setDefaultProperties(",
    "ConfigurableEnvironment",
    "MutablePropertySources",
    "MockEnvironment",
    "MockPropertySource",
]

# Diff text that must not leave the workspace.
SENSITIVE_DIFF = (
    r"(?i)(?:\.env(?:\.|$)|benchmark|readme|api[_ -]?key|authorization\s*:\s*bearer|"
    r"\\\\[a-z]|/(?:tmp|var|home|users?)/|\bsk-[a-z0-9]{16,}\b)"
)
WINDOWS_DRIVE_PATH = r"(?i)(?<![a-z0-9_])[a-z]:[\\/](?=[^\\/\s]|$)"
# ------------------------------------------------------------ end fixed values
