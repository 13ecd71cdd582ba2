"""Values that define results: thresholds, word lists and patterns (Java syntax).

Loops that could give back what can't help a match are possessive, and runs of white space are matched from their beginning only, so that no pattern takes
more than linear time over long runs of blanks, newlines or labels, or deep recursion.
"""

from __future__ import annotations

# --- fixed values: thresholds ---
CHARS_PER_TOKEN = 3.1
CONTEXT_WINDOW = 200_000
VERBATIM_TURNS = 10
MAX_RULES, MIN_RULE_LENGTH, MAX_RULE_LENGTH = 20, 10, 800
STORE_RULES, STORE_HARD_MAX, STORE_MAX_JUMP = 30, 50, 20
STORE_WARN_LENGTH, STORE_SAVE_LENGTH = 2000, 1200
DUPLICATE_LINE_LENGTH, COLLAPSE_LENGTH, HASH_PREFIX = 200, 60, 2000
NEAR_DUPLICATE, HEADER_SLACK = 0.5, 30
FEW_RULES, FEW_RULES_TURNS, SHOWN_RULES, SHOWN_RULE_LENGTH = 3, 10, 5, 72
MAX_INPUT_CHARS, WARN_INPUT_CHARS = 2_000_000, 5 * 1024 * 1024
CLOSERS = ")]\"'’”"
CONTAINER_KEYS = ("messages", "conversation", "chat_messages", "turns")
#: Terms that keep a long sentence whole.
SAFETY_TERMS = ("hate crime", "physical safety", "jeopardy", "endangered", "anti-trans")
#: Terms for which a rule is made if none has been found.
PROTECTED_TERMS = ("anti-trans hate crime", "physical safety", "jeopardy from an")
#: What each strength does to older turns.
PRESCRIPTIONS = {
    "gentle": {"boilerplate"},
    "standard": {"boilerplate", "acknowledgement", "dedup", "collapse"},
    "aggressive": {"boilerplate", "acknowledgement", "dedup", "collapse", "compress"},
}

#: White space, as Python's ``str.strip`` takes it.
SPACE = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"

# --- fixed values: patterns of noise ---
THINKING = r"(?is)<thinking>.*?</thinking>|<think>.*?</think>"
TAGS = (
    r"(?s)<system-reminder>.*?</system-reminder>"
    r"|<local-command(?:-caveat|-stdout|-stderr)?>.*?</local-command(?:-caveat|-stdout|-stderr)?>"
    r"|<command-(?:name|message|args)>.*?</command-(?:name|message|args)>"
)
#: What the patterns above join: flags, and the names that open and close a block of each kind.
THINKING_KINDS = ("i", ("thinking", "think"))
TAG_KINDS = ("", ("system-reminder", "local-command(?:-caveat|-stdout|-stderr)?", "command-(?:name|message|args)"))
#: A line of at most 200 characters and the same line below it; replaced from the left, so a run of n leaves its first, third, ...
LINE_PAIR = r"(?dm)^([^\S\n]*+)(\S(?:[^\n]{0,198}\S)?)([^\S\n]*+)\n[^\S\n]*+\2[^\S\n]*+$"
MORE_FIRST = r"\A(?:[^\S\n]*+Show more[^\S\n]*+(?:\n|\z))++"
MORE_LATER = r"\n[^\S\n]*+Show more[^\S\n]*+(?=\n|\z)"
CODE = r"```[\s\S]*?```|`[^`\n]+`"
CHUNK_BREAK = r"((?<=[.!?])\s+(?=[A-Z])|\n{2,})"

# --- fixed values: filler of assistants ---
OPENER_A = r"(?iu)\A\s*+(?:Of course|Certainly|Sure|Absolutely|Great(?: ++question)?)[!,]?[ \t]++[^\n]*+\n\n?"
OPENER_B = (
    r"(?iu)\A\s*+(?:I'?(?:'ll|'d)(?: be)? (?:happy|glad|delighted)(?: to)? (?:help|analyze|review|look at|work through)"
    r"|Let me (?:carefully |thoroughly |systematically )?(?:analyze|review|work through|look at|help|walk you through)"
    r"|I'?(?:'ve)? (?:carefully |thoroughly )?(?:reviewed|analyzed|evaluated|gone through|looked at))[^\n]*+\n\n?"
)
CLOSER = (
    r"(?imd)(?:(?<!\n)|\G)\n++(?:(?:Let|Please let) me know(?: if| what| how)"
    r"|(?:Feel|Please feel) free to (?:ask|let me know|reach out|share)"
    r"|(?:I )?hope this (?:helps?|(?:has been|was) helpful|gives?|provides?)"
    r"|I'?(?:'m|'ll) (?:here|happy|available|glad)(?: to)? (?:help|assist|answer|make|revisit|adjust)"
    r"|happy to (?:help|assist|elaborate|dive|explore|clarify|discuss|revisit|adjust)"
    r"|would you like (?:me to|to)"
    r"|is there anything (?:else|more|other)"
    r"|want me to)[^\n]*[.!?]?\s*$"
)
ACKNOWLEDGEMENT = (
    r"(?iu)\A\s*+(?:Yes(?:,| -)? (?:you(?:'re| are) right|absolutely|exactly|that(?:'s| is) (?:correct|a good point|fair))"
    r"|I(?: fully)? understand"
    r"|That(?:'s| is)(?: a)? (?:great|good|fair|excellent|valid)"
    r"|You(?:'re| are)(?: absolutely| totally)? right)[^\n]*+\n\n?"
)

# --- fixed values: what makes a sentence of a user a rule, and what makes one of an assistant worth keeping ---
CORRECTION = (
    r"(?iu)\b(?:don'?t|do not|please don'?t|never|always|stop\s+\w+ing|from now on|remember to|remember that|make sure to|make sure you"
    r"|you shouldn'?t|use .{1,30} instead)\b"
)
IMPLICIT_CORRECTION = (
    r"(?iu)\bactually[,.]|\bthat's not right\b|\bthat's incorrect\b|\bno[, ]+that's\b|\bwait[, ]+no\b|\bI meant\b|\bI said\b|\bsorry[, ]+but\b|\bactually[, ]+I\b"
)
#: The sentence around a trigger that goes across a full stop, from the one before it to the one after it.
ACROSS = r"(?iu)(?<![^.\n])[^.\n]*\buse (?=[^\n]{1,30} instead\b)[^.\n]{0,29}\.[^\n]{0,29}? instead\b[^.\n]*+\.?"
SIGNAL = (
    r"(?iu)\b(?:error|result|output|fixed|fix|note|warning|important|must|should|resolved|completed|configured|installed|returns?|raises?|set|use|run|add|remove"
    r"|decided|conclusion)\b"
)

# --- fixed values: labels in pasted text ---
COLON_LABEL = (
    r"(?imd)^[^\S\n]*+(?:\[\d{1,2}:\d{2}(?:\s*[AP]M)?\]\s*+)?(?:\*\*|__)?[ \t]*(You|User|Human|Assistant|Claude(?:[ \t]+[A-Za-z0-9][A-Za-z0-9.]*){0,3}|AI)(?:\*\*|__)?[ \t]*"
    r"(?:\[\d{1,2}:\d{2}(?:\s*[AP]M)?\])?[ \t]*:\s*+"
)
SOLO_LABEL = r"(?imd)^[^\S\n]*+(You|User|Human|Assistant|Claude(?:[ \t]+[A-Za-z0-9][A-Za-z0-9.]*){0,3}|AI)[^\S\n]*+$"
DATE_LINE = r"(?imd)^[^\S\n]*+(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\s+\d{1,2}[^\S\n]*+$"
HISTORY = r"(?ismd)\A.*?^## conversation history[^\n]*\n"
ASKS = r"(?iu)\A(?:\?|I need|Can you|Please|I want)"
ASKS_EARLY = r" i |i'm|i've|i'll|can you|please|\?"
