"""Fixed values and defaults of the engine."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Defaults:
    chunk_chars: int = 3200
    overlap_chars: int = 600
    merge_chars: int = 640
    table_chars: int = 400
    top_k: int = 12
    top_k_each: int = 6
    rrf_k: int = 2
    bm25_k1: float = 1.2
    bm25_b: float = 0.75
    graph_score: float = 0.5
    lookup_cap: int = 64
    rerank_candidates: int = 50
    rerank_chars: int = 1000
    rerank_weight: float = 0.6
    pool_cap: int = 80
    verify_window: int = 12
    answer_window: int = 10
    claim_chars: int = 60
    sufficient: float = 0.65
    least_gain: float = 0.05
    out_of_scope: float = 0.25
    max_passes: int = 2
    hops: int = 2
    seeds: int = 6
    seed_pool: int = 4
    hub_floor: int = 10
    hub_multiple: int = 8
    hub_share: float = 0.99
    edge_cap: int = 80
    chunk_cap: int = 24
    history_turns: int = 8
    json_depth: int = 12
    json_lines: int = 400
    json_records: int = 3
    zip_depth: int = 3
    zip_entries: int = 500
    zip_bytes: int = 500 * 1024 * 1024
    zip_range: int = 32 << 20
    zip_ratio: int = 120
    zip_ratio_from: int = 256 * 1024


DEFAULTS = Defaults()

# ---- Fixed values: words and patterns that results depend on --------------------------------------------------------

#: Capitalised words that name nothing.
CAPITALISED_STOPWORDS = (
    "The This That These Those There Then They It Its We You He She His Her Their Our And But For With From Into Also "
    "However Therefore Figure Table Chapter Section Page Note Example Abstract Introduction Conclusion References Appendix "
    "January February March April May June July August September October November December Monday Tuesday Wednesday "
    "Thursday Friday"
).split()

#: Question words that name nothing.
QUESTION_STOPWORDS = (
    "what which who whom whose when where why how does did do is are was were the and for with from that this these those "
    "about into than then there their they have has had been being can could would should will shall may might must tell "
    "show give list explain describe compare between related relationship connection affect affected impact under upon "
    "within without through during against above below across among along toward towards made"
).split()

#: First words of names that only point back.
BACK_REFERENCES = "this that these those such any said other certain all some every each either both another same".split()

#: Words and phrases that need an earlier turn.
REFERENCE_WORDS = "it its they them their this that these those he she him his her hers one ones both".split()
REFERENCE_PHRASES = (
    "the same", "the above", "the previous", "the former", "the latter", "what about", "how about", "as well", "instead",
    "earlier", "previously", "mentioned", "you said", "your answer",
)

#: Markers of routes.
GREETING = (
    r"(?i)^\s*(hi|hey|hello|yo|good\s+(morning|afternoon|evening)|thanks?|thank\s+you|ok(ay)?|cool|nice|great|bye|goodbye|test)\b[\s!.?]*$"
)
META = r"(?i)\b(who are you|what are you|what can you do|how do you work|your name|help me|what is this|how does this work)\b"
RELATION_MARKERS = (
    "relationship", "related to", "connection", "connected", "link between", "linked to", "associated with", "depends on",
    "dependency", "affects", "affected by", "impacts", "impacted by", "influences", "caused by", "causes", "leads to",
    "results in", "works for", "belongs to", "part of", "owned by", "reports to", "interacts with", "who is involved",
    "network of", "downstream", "upstream", "between",
)
MULTIHOP_MARKERS = (
    "compare", "comparison", "versus", " vs ", "difference between", "differences", "contrast", "both", "all of the",
    "each of the", "step by step", "trace", "and then", "as well as", "in addition to", "which of these", "rank",
    "pros and cons", "trade-off", "tradeoff", "summarize all", "across all",
)
LOOKUP_STARTS = (
    "what is", "what are", "what does", "define", "definition of", "explain", "describe", "summarize", "summarise",
    "tell me about", "how do i", "how to", "when was", "when did", "where is", "list the", "what was",
)

#: References to the evidence, and words of absence.
EVIDENCE_REFERENCE = (
    r"(?i)\b(?:this|the)\s+knowledge\s+base\b|\b(?:these|those|the|available|provided|retrieved|supplied|given)\s+"
    r"(?:\w+\s+){0,2}(?:sources?|extracts?|passages?|excerpts?|corpus|materials?)\b"
)
ABSENCE = r"(?i)\b(?:no|not|none|nothing|never|missing|absent|lacks?|lacking|silent|beyond)\b"

#: Entity kinds; a kind that is not among them counts as OTHER.
ENTITY_KINDS = "PERSON ORGANIZATION LOCATION PRODUCT TECHNOLOGY CONCEPT EVENT METRIC DOCUMENT OTHER".split()

#: File endings that are taken in, and the first bytes each must have.
EXTENSIONS = ".pdf .docx .txt .md .json .png .jpg .jpeg .webp .bmp .gif .zip".split()
SIGNATURES = {
    ".pdf": ["255044462D"], ".docx": ["504B0304"], ".zip": ["504B0304", "504B0506", "504B0708"],
    ".png": ["89504E470D0A1A0A"], ".jpg": ["FFD8FF"], ".jpeg": ["FFD8FF"], ".gif": ["474946383761", "474946383961"],
    ".bmp": ["424D"], ".webp": ["52494646"],
}

#: Errors that pass and errors that stay.
FATAL_MARKERS = (
    "api key not valid", "api_key_invalid", "invalid api key", "permission denied", "unauthorized", "401", "403",
    "not found", "404", "model_not_found", "does not exist", "deploymentnotfound", "content_filter",
    "content management policy", "responsibleaipolicyviolation", "invalid_request_error", "unsupported_parameter",
    "unsupported_value", "context_length_exceeded",
)
RETRYABLE_MARKERS = (
    "429", "rate limit", "rate_limit", "resource exhausted", "resource_exhausted", "quota", "500", "502", "503", "504",
    "overloaded", "unavailable", "deadline", "timeout", "timed out", "connection reset", "connection error", "temporarily",
)
