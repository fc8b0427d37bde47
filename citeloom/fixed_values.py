"""Fixed values.

The word lists, thresholds, labels and formats below decide result equality, so they
are stated as plain data. Every function that uses one takes it as a parameter, so a
caller may pass its own list. Watchlists and question lists are never built in: they
are input tables.
"""

# -- tokens ---------------------------------------------------------------------------
STOP_TERMS = (
    "a", "about", "an", "and", "are", "as", "at", "be", "by", "can", "do", "does", "doc",
    "docs", "document", "documents", "explain", "explained", "explains", "file", "files",
    "for", "from", "how", "in", "into", "is", "it", "mention", "mentioned", "mentions",
    "of", "on", "or", "project", "said", "say", "says", "that", "the", "this", "to",
    "what", "where", "which", "who", "why", "with",
)
SYMBOL_HEX_CHARS = 12
MAX_BLOCK_LINES = 40
TEXT_SUFFIXES = (".txt", ".md", ".markdown", ".rst", ".csv", ".json", ".jsonl")
RELATION_WINDOW = 6

# -- ranking --------------------------------------------------------------------------
DIRECT_WEIGHT = 80
NEIGHBOR_LIMIT = 16
TOP_TIER_WEIGHT = 4
TIER_WIDTH = 4
MIN_CANDIDATES = 25
CANDIDATES_PER_ANSWER = 5

# -- evidence gate --------------------------------------------------------------------
LOW_VALUE_TERMS = (
    "answer", "ask", "asked", "claim", "data", "dataset", "describe", "described",
    "evidence", "find", "found", "give", "local", "provide", "question", "row",
    "section", "show", "staged", "under", "value",
)
BROAD_HEADINGS = (
    "background", "citation integration", "citations pane", "conclusion", "discussion",
    "governance", "implemented", "methods", "next steps", "overview", "results",
    "summary", "user upload", "what it opens",
)
BROAD_HEADING_PREFIXES = ("implemented", "next steps")
PATH_INTENT_WORDS = ("api", "config", "endpoint", "file", "path", "route", "url")
SLASH_PHRASE = r"\b[a-zA-Z]{2,}/[a-zA-Z]{2,}\b"
TRUE_PATH_PATTERNS = (
    r"[A-Za-z]:\\",
    r"[/\\][A-Za-z0-9_.-]+[/\\]",
    r"\bapi/[A-Za-z0-9_./{}-]+",
    r"/api/[A-Za-z0-9_./{}-]+",
    r"\b[A-Za-z0-9_.-]+\.(json|toml|yaml|yml|py|md|txt|csv)\b",
)
HEADING_MAX_CHARS = 80
HEADING_COVERAGE = 0.75
REFUSAL_TERMS, REFUSAL_COVERAGE = 4, 0.50
OBJECT_TERMS, OBJECT_COVERAGE = 3, 0.34
COVERAGE_WEIGHT, MAX_HIT_BONUS, HEADING_PENALTY = 8.0, 4.0, 3.0

# -- support ladder -------------------------------------------------------------------
LADDER = (
    ("L1", "artifact_or_subject_referenced"),
    ("L2", "artifact_existence_evidenced"),
    ("L3", "artifact_contents_recovered"),
    ("L4", "artifact_modification_evidenced"),
    ("L5", "artifact_referenced_after_modification"),
    ("L6", "deletion_or_rejection_discussed"),
    ("L7", "deletion_or_rejection_evidenced"),
    ("L8", "contradictory_statements_found"),
    ("L9", "execution_or_deployment_evidenced"),
)
LADDER_CUES = {
    "L3": ("```", "def ", "class ", "function ", "import ", ".py", "module 1", "module_"),
    "L4": ("modified", "updated", "changed", "rewrote", "patched", "edited", "version"),
    "L5": ("after", "later", "then", "again"),
    "L6": ("deleted", "delete", "threw it away", "thrown away", "ditched", "discarded",
           "rejected", "not as a build plan"),
    "L7": ("deletion receipt", "delete log", "removed from disk", "file no longer exists",
           "not recovered"),
    "L8": ("contradiction", "contradictory", "conflict", "conflicting statement",
           "inconsistent"),
    "L9": ("executed", "ran command", "ran script", "deployed", "launched", "installed",
           "in production", "production deployment"),
}

# -- chat headers ---------------------------------------------------------------------
CHAT_KEYS = {
    "conversation_id": "CHAT_CONVERSATION_ID",
    "message_id": "CHAT_MESSAGE_ID",
    "title": "CHAT_TITLE",
    "created_at_original": "CHAT_CREATED_AT",
    "speaker": "CHAT_SPEAKER",
    "truth_scope": "CHAT_TRUTH_SCOPE",
    "lifetime_allowed": "CHAT_LIFETIME_ALLOWED",
}
CHAT_TURN_HEADING = r"(?md)^##\s+CHAT_TURN_([0-9]+)\s*$"
DEFAULT_TRUTH_SCOPE = "system_doctrine_not_world_truth"

# -- crosslinks -----------------------------------------------------------------------
CROSSLINK_BLOCKED = (
    "assistant", "because", "chat", "conversation", "could", "created", "doctrine",
    "export", "false", "from", "id", "message", "model", "scope", "should", "source",
    "speaker", "system", "text", "that", "there", "these", "this", "those", "truth",
    "turn", "user", "with", "would",
)
CROSSLINK_MIN_SHARED = 3
CROSSLINK_SHOWN_TERMS = 30
CROSSLINK_STRONG, CROSSLINK_PARTIAL = 8, 5

# -- watchlist context ----------------------------------------------------------------
MAX_HITS_PER_TERM = 500
CONTEXT_TERMS = 12
NESTED_LIMIT = 50
CONTEXT_BLOCKED = (
    "and", "chat_speaker", "chat_text", "chat_title", "that", "the", "this", "with", "you",
)
RESPONSE_SHAPES = (
    ("boundary_instruction_shape", ("do not", "no ", "must")),
    ("test_report_shape", ("test", "pass", "failed")),
    ("plan_shape", ("plan", "step")),
)

# -- preflight ------------------------------------------------------------------------
MAX_EXPECTED = 8
SUGGEST_MIN_CHARS, SUGGEST_LENGTH_GAP, SUGGEST_MIN_RATIO = 3, 3, 0.86

# -- frames ---------------------------------------------------------------------------
CLOUD_K = 6
CLOUD_NEIGHBOR_FACTOR = 12
WINDOW_RADIUS = 6
MAX_WINDOWS = 4

# -- rounds ---------------------------------------------------------------------------
MAJOR_BLOCKED = (
    "about", "chat", "data", "did", "does", "from", "mean", "means", "that", "the",
    "this", "what", "with",
)
OUTSIDE_PHRASES = (
    "as an ai", "from general knowledge", "i know that", "it is well known",
    "outside the dataset",
)
STRONG_CLAIM_TERMS = ("proves", "guarantees", "always", "never", "cures")

# -- speech vocabulary ----------------------------------------------------------------
GLUE_TERMS = (
    "the", "a", "an", "this", "that", "it", "they", "he", "she", "his", "her", "and",
    "or", "but", "because", "with", "as", "in", "on", "by", "for", "from", "to", "of",
)
GLUE_PREFERENCE = ("and", "with", "as")
RELATION_PHRASES = {
    "supports": "supports",
    "contradicts": "contradicts",
    "related": "is related to",
    "not_enough_data": "does not provide enough evidence for",
}

# -- message routing ------------------------------------------------------------------
ROUTING_URGENCY = (
    "now", "right now", "quick", "urgent", "asap", "immediately", "client waiting",
    "deadline",
)
ROUTING_CONFUSION = (
    "i don't know", "what is this", "why", "how", "unclear", "confused",
    "doesn't make sense",
)
ROUTING_THREAT = ("blow up", "burn", "kill", "hurt", "destroy", "punch", "attack")
ROUTING_GROUPS = {
    "affect": ("garbage", "junk", "broken", "useless", "trash", "sick of", "fed up",
               "bullshit", "wrong", "nightmare"),
    "command": ("add", "audit", "back up", "backup", "build", "check", "commit", "compare",
                "delete", "fix", "get", "inspect", "open", "prove", "read", "remove",
                "restore", "run", "show", "start", "test", "trace", "write"),
    "target": ("branch", "citation", "citations", "count", "counts", "dataset",
               "dataset id", "file", "file path", "folder", "main branch", "receipt",
               "receipt files", "repo", "repository", "runtime", "score", "status",
               "trace"),
    "urgency": ROUTING_URGENCY,
    "threat": ROUTING_THREAT,
    "confusion": ROUTING_CONFUSION,
    "care_priority": ("protect", "backup", "back up", "preserve", "do not lose",
                      "important", "my project", "project matters", "my family",
                      "my daughter", "production", "main branch"),
    "ambiguity": ("all", "everything", "it", "this", "that", "the whole thing",
                  "the folder", "the repo"),
    "evidence": ("prove", "receipt", "citation", "citations", "where did it come from",
                 "show the score", "show the weight", "score", "weight", "trace", "audit",
                 "support", "evidence"),
    "mutation": ("delete", "remove", "wipe", "clear", "purge", "overwrite", "reset",
                 "destroy", "trash", "nuke"),
}

# Forms of follow-up questions (our own wording).
PAIR_QUESTION = "Which cited lines tie %s to %s?"
SINGLE_QUESTION = "Which cited lines speak of %s?"
