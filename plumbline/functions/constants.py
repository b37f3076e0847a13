"""Word lists, patterns and tables that results depend on."""

FUNCTION_WORDS = (
    "the", "be", "to", "of", "and", "a", "in", "that", "have", "it",
    "for", "not", "on", "with", "he", "as", "you", "do", "at", "this",
    "but", "his", "by", "from", "they", "we", "say", "her", "she", "or",
    "an", "will", "my", "one", "all", "would", "there", "their", "what",
    "so", "up", "out", "if", "about", "who", "get", "which", "go", "me",
    "when",
)

HEDGE_WORDS = (
    "possibly", "perhaps", "likely", "generally", "often", "sometimes",
    "usually", "typically", "approximately", "roughly", "nearly",
    "presumably", "apparently", "seemingly", "arguably", "potentially",
)

HEDGE_PHRASES = (
    "may be", "might be", "could be", "seems to", "appears to",
    "suggests that", "it is possible", "arguably", "presumably",
    "to some extent", "in general", "typically", "often",
    "we believe", "we suggest", "we argue", "we propose",
)

COHERENCE_HEDGES = (*HEDGE_PHRASES, "it can be argued", "one could argue")

CONNECTORS = (
    "furthermore", "moreover", "additionally", "in conclusion", "in summary",
    "it is worth noting", "it should be noted", "needless to say",
    "it is important to note", "in this regard", "in this context",
    "with respect to", "with regard to", "in the context of",
    "as mentioned above", "as discussed above", "as noted above",
    "on the other hand", "on the contrary", "in contrast",
    "to summarize", "to conclude", "to reiterate",
    "first and foremost", "last but not least", "as a result",
    "consequently", "therefore", "thus", "hence",
)

TEMPLATE_SECTIONS = (
    "introduction", "background", "related work", "literature review",
    "methodology", "methods", "proposed approach", "experimental setup",
    "experiments", "results", "discussion", "conclusion", "future work",
    "acknowledgment", "references",
)

NOMINAL_SUFFIXES = ("tion", "sion", "ness", "ment", "ity", "ism", "ance", "ence", "ery")

PASSIVE = (
    r"\b(is|are|was|were|be|been|being)\s+"
    r"(\w+ed|shown|demonstrated|proposed|observed|found|given|known|"
    r"used|applied|performed|conducted|analyzed|measured|evaluated)\b"
)

LANGUAGE_MULTIPLIERS = {
    "zh": 0.80, "ko": 0.80, "ja": 0.80, "ar": 0.82, "fa": 0.82, "ru": 0.85, "uk": 0.85,
    "es": 0.88, "pt": 0.88, "it": 0.88, "de": 0.90, "fr": 0.90, "en": 1.00,
}
OTHER_LANGUAGE = 0.90

PREDATORY_NAMES = (
    r"\bInternational Journal of (?:Advanced|Novel|Innovative|Modern) (?:Research|Studies|Science)\b",
    r"\bJournal of (?:Emerging|Global) (?:Research|Studies|Trends)\b",
    r"\bWorld Journal of (?:Science|Research|Innovation)\b",
    r"\bAmerican Journal of (?:Advanced|Modern) (?:Research|Science)\b",
    r"\bEuropean Journal of (?:Academic|Applied) (?:Research|Studies)\b",
    r"\bInternational Research Journal\b",
    r"\bGlobal Journal of (?:Pure|Applied) (?:Science|Research)\b",
)
PREDATORY_PUBLISHERS = (r"\bOmics\b", r"\bHilaris\b", r"\bScitechnol\b", r"\bWaxmann\b", r"\bBentham Open\b", r"\bIntech\b")

VENUES = (
    r"(?:In |Proc\. |Proceedings of )?([A-Z][^,.]{5,60}(?:Conference|Symposium|Workshop|Journal|Transactions|Letters|Review))",
    r"(?:IEEE|ACM|Elsevier|Springer|Nature|Science)\s+[A-Z][^,.]{5,60}",
)

ABBREVIATIONS = r"\b(e\.g|i\.e|et al|Fig|Tab|Eq|cf|vs|Dr|Mr|Mrs|Prof|al|approx)\."

CONTENT_STOPS = (
    "the", "be", "to", "of", "and", "a", "in", "that", "have", "it", "for", "not",
    "on", "with", "as", "by", "from", "they", "we", "this", "an", "is", "are", "was",
    "were", "or", "at", "but", "which", "their", "can", "also", "such", "our", "these",
    "has", "been", "more", "its", "than", "may", "using", "used", "each", "into",
)

RISKS = ("LOW", "MEDIUM", "HIGH", "CRITICAL")

GUIDANCE = {
    "CRITICAL": "Over 30% overlap, or many verbatim passages: tell the editors at once and rewrite or remove the passages before submission.",
    "HIGH": "15 to 30% overlap: cite the earlier work explicitly and state the overlap in the cover letter; methods sections are partly exempt.",
    "MEDIUM": "5 to 15% overlap: standard methods text is mostly acceptable; cite reused text and consider a short statement in the cover letter.",
    "LOW": "Under 5% overlap: usual for academic writing; nothing to declare, but earlier work is still to be cited.",
}
