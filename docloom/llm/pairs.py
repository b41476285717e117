"""Defects of prompt and response pairs.

Each answer is stripped of its citations and then judged: placeholders are empty;
refusal grammars go over its sentences; greedy string tiling measures how much of it
is the question given back; a pushdown parser over fences, brackets, quotations,
lists and markup, with the last words, tells whether it breaks off; scripts and
n-gram profiles tell its language from the question's.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._plan import SALTS, arrow_once, small_enough
from .languages import Languages, learn

DEFECTS = ("empty", "refusal", "copies_question", "truncated", "other_language")
BROADCAST_ROWS = 200_000
MAX_WORDS = 100_000

_LIST = re.compile(r"\s*\[([^\[\]\n]*)(\]?)\s*\Z")
_ID = re.compile(r"[\w-]+(?:_[\w-]+)+|\d+")
_TAG = re.compile(r"</?[a-z][\w-]*(?:\s[^<>]*)?/?>", re.I)
_LEAD = re.compile(r"^\s*(?:(?:final\s+)?(?:answer|response|reply|output|antwort|réponse|respuesta)\s*[:：])+\s*", re.I)
_PLACEHOLDER = re.compile(r"(?:n\s*/?\s*a|none|null|nil|nan|undefined|todo|tbd|tba|empty|blank|no (?:answer|response|output|content)|not (?:available|applicable)|placeholder|\[?(?:answer|response|insert[^\]]*)\]?|lorem ipsum.*)[.!]?", re.I)
_CONTENT = re.compile(r"[^\W_]")


def body_of(answer: str, citations: frozenset[str] = frozenset()) -> str:
    """The answer without the citation lists at its end.

    A bracketed list at the end is one of citations if each entry is among those
    given with the answer or looks like an id; one that breaks off may end in a part of one.
    """
    while m := _LIST.search(answer):
        entries = [e for x in re.split("[,;]", m[1]) if (e := x.strip())]
        cited = [e in citations or _ID.fullmatch(e) is not None for e in entries]
        if not m[2] and entries and not cited[-1]:
            cited[-1] = "_" in entries[-1] or any(c.startswith(entries[-1]) for c in citations)
        if not entries or not all(cited):
            break
        answer = answer[: m.start()]
    return answer.strip()


def is_empty(body: str) -> bool:
    """Whether nothing is said but for a placeholder."""
    text = _LEAD.sub("", _TAG.sub(" ", body)).strip()
    return not _CONTENT.search(text) or bool(_PLACEHOLDER.fullmatch(text.strip(" \t\n\"'`*()[]{}<>-–—")))


# --- refusals -----------------------------------------------------------------

# Nonterminals of the grammars, by language; gaps are bounded and stay within a clause.
_EN = {
    "self": r"\b(?:i|we|this (?:assistant|service|system|model))\b",
    "me": r"\b(?:me|us|this (?:assistant|service|system|model))\b",
    "not": r"(?:can\s?not|can't|could\s?n[o']t|won't|will not|would not|wouldn't|do not|don't|did not|didn't|am not|'m not|are not|must not|may not|shall not|should not|(?:am|'m|are|be) (?:un|not )able|unable|not (?:able|permitted|allowed|free|authori[sz]ed)|have to|must|would rather(?: not)?|'d rather(?: not)?|prefer (?:not )?to|refuse|decline|lack|impossible)",
    "say": r"(?:answer|respond|reply|help|assist|say|tell|provide|comply|discuss|talk|speak|comment|share|give|offer|explain|elaborate|address|determine|find|know|guess|speculate|judge|verify|confirm|fulfil+|support|continue|proceed|engage|advise|decline|abstain|refrain|pass|skip|leave|information|knowledge|evidence|context)",
    "source": r"\b(?:context|passages?|excerpts?|materials?|documents?|sources?|chunks?|texts?|snippets?|references?)\b",
    "proof": r"(?:evidence|context|information|data|materials?|details?|knowledge|basis|grounds)",
    "topic": r"\b(?:questions?|requests?|query|queries|topics?|subjects?|matters?|this|that|it)\b",
    "closed": r"\b(?:off[- ]?limits|out of (?:scope|bounds)|(?:is|are) (?:forbidden|prohibited|not (?:allowed|permitted|something (?:i|we)))|(?:outside|beyond) (?:of )?(?:my|our|the|what))\b",
    "rules": r"\b(?:guidelines?|policy|policies|rules?|instructions|programming|terms)\b",
}
_REFUSALS = [
    # someone who is not able or willing to say something
    "{self}[^.:;]{{0,40}}?{not}\\b[^.:]{{0,60}}?\\b{say}\\b",
    "{self} (?:really |simply |just |honestly )?(?:do not|don't) (?:know|have (?:enough|any|the|that|sufficient))\\b(?!\\s+(?:a|an|any|of)\\s+\\w+er\\b)",
    "^(?:i am|i'm|we are|we're) (?:not (?:sure|certain|able|in a position)|unable|unsure)\\b",
    "^(?:i am|i'm|we are|we're) (?:so |very |truly |really )?sorry[,.]?(?:\\s(?:but|for)\\b.*)?$",
    "^(?:sorry|apologies|my apologies|unfortunately|regrettably)[,:]?\\s[^.]{{0,60}}(?:\\b{not}\\b|{closed}|\\bno answer\\b)",
    "^(?:(?:must|have to|want to) )?(?:cannot|can't|can not|unable to|not able to|will not|won't|must not|refuse to|refusing to|decline to|declining to|must) {say}\\b",
    "\\b(?:it|that|this) (?:would be|is|seems) (?:impossible|inappropriate|not (?:possible|appropriate)) for {me}|\\bit would not be (?:possible|appropriate|right|proper) for {me}",
    "\\bas an? (?:ai|assistant|language model|chatbot)\\b[^.]{{0,60}}\\b{not}\\b",
    # something that is not there to answer from
    "\\b(?:no|not any) (?:answer|reply|response|conclusion|statement)s? (?:(?:is|are|was|can be|could be|will be) )?(?:possible|given|available|offered|provided|on\\b|to (?:this|that|the) question)",
    "\\b(?:insufficient|not enough|too little|inadequate|no) (?:\\w+ )?{proof}\\b(?= (?:to|for|on|about|is|are|was|were|in)\\b|[.!]?$)",
    "\\b(?:insufficient|not enough|too little|inadequate) {proof}\\b",
    "{source}[^.:]{{0,50}}\\b(?:does not|doesn't|do not|don't|fails? to|did not|didn't|never)\\b[^.:]{{0,30}}\\b(?:enough|sufficient|answer|cover|mention|address|say|contain|include|provide|deal|support)\\b",
    "{topic}[^.:]{{0,40}}\\b(?:cannot|can't|can not|could not) be (?:answered|resolved|addressed|determined|decided|fulfilled|discussed|settled|judged)\\b",
    # something that may not be talked about
    "{topic}[^.:]{{0,30}}{closed}",
    "{rules}[^.:]{{0,30}}\\b(?:prevents?|forbids?|prohibits?|do(?:es)? not (?:let|allow|permit)|keeps?|stops?)\\b[^.:]{{0,10}}{me}",
]
_DE = {
    "self": r"\b(?:ich|wir)\b",
    "may": r"\b(?:kann|können|könnte|darf|dürfen|möchte|möchten|werde|werden|weiß|wissen)\b",
    "not": r"\b(?:nicht|kein\w*|nichts)\b",
    "source": r"\b(?:kontext|auszüge|textstellen|unterlagen|quellen|passagen|abschnitte|dokumente)\b",
    "proof": r"\b(?:antwort|auskunft|angaben|informationen|belege)\b",
}
_REFUSALS_DE = [
    "{may}[^.]{{0,30}}{self}[^.]{{0,60}}{not}",
    "{self}[^.]{{0,15}}{may}[^.]{{0,60}}{not}",
    "{source}[^.]{{0,30}}\\b(?:enthält|enthalten|bietet|bieten|reicht|reichen|geben|gibt)\\b[^.]{{0,30}}{not}",
    "\\b(?:keine|nicht genügend|unzureichende) (?:ausreichenden )?{proof}[^.]{{0,40}}\\b(?:möglich|geben|vorhanden|verfügbar)\\b",
]
_FR = {"self": r"\b(?:je|nous)\b", "may": r"\b(?:peux|puis|peut|pouvons|suis|sais|savons|dispose|disposons|veux|souhaite|ai|avons)\b", "not": r"\b(?:pas|rien|aucune?)\b", "source": r"\b(?:contexte|extraits|passages|documents|sources)\b"}
_REFUSALS_FR = [
    "{self}[^.]{{0,20}}\\b(?:ne|n')\\s?[^.]{{0,30}}{may}[^.]{{0,12}}{not}",
    "{source}\\s+(?:\\w+\\s+)?(?:ne |n')(?:permet|permettent|contien|suffi|fourni|mentionn)\\w*\\s+pas\\b",
    "\\b(?:aucune réponse|informations? insuffisantes?|pas assez d'informations?)\\b",
]
_ES = {"may": r"(?:puedo|podemos|sé|sabemos|tengo|tenemos|dispongo|me es posible|es posible responder|estoy autorizad\w+)", "source": r"\b(?:contexto|fragmentos|documentos|pasajes|fuentes)\b"}
_REFUSALS_ES = [
    "\\bno {may}\\b",
    "{source}\\s+(?:\\w+\\s+)?no\\s+(?:contienen?|tienen?|incluyen?|ofrecen?|permiten?|mencionan?|bastan?)\\b",
    "\\b(?:información insuficiente|ninguna respuesta)\\b",
]
_GRAMMARS = ((_REFUSALS, _EN), (_REFUSALS_DE, _DE), (_REFUSALS_FR, _FR), (_REFUSALS_ES, _ES))
_REFUSAL = re.compile("|".join(f"(?:{rule.format(**terms)})" for rules, terms in _GRAMMARS for rule in rules), re.I)
#: Of which every rule needs one; searched for first, since most sentences have none.
_TRIGGERS = (
    "not", "n't", "no ", "no\t", "unable", "unsure", "have to", "must", "rather", "prefer", "refus", "declin", "lack", "possible", "appropriate", "sorry", "apolog", "unfortunately", "regrettably", "insufficient", "too little", "inadequate",
    "fail", "never", "limits", "out of", "forbid", "prohibit", "outside", "beyond", "prevent", "keep", "stop", "nicht", "kein", "pas", "rien", "aucun", "unzureichend", "insuffisant", "insuficiente", "ninguna",
)


def _refuses(sentence: str) -> bool:
    lowered = sentence.lower()
    return any(t in lowered for t in _TRIGGERS) and _REFUSAL.search(sentence) is not None


#: Sentences of the first person that do give an answer.
_ANSWERS = re.compile(r"\b(?:than (?:this|that)|the following|otherwise|because|since it|namely|to say that)\b\s*:?|:\s+\w+(?:\s+\S+){3,}$", re.I)
_REASON = re.compile(r"\b(?:because|since)\b[^.]*\b(?:passages|context|excerpts|material|documents|sources|guidelines|policy|chunks)\b", re.I)
_FILLER = re.compile(
    r"^(?:hello|hi|hey|hallo|bonjour|hola|dear user|greetings)\b[^.!]{0,20}[.!,]*$|^(?:thanks|thank you|danke|vielen dank|merci|gracias)\b[^.!?]{0,40}[.!]*$"
    r"|^(?:please|kindly|try|ask|consult|contact|refer|feel free|bitte|veuillez|por favor|let me know|consider asking|see)\b[^.!?]{0,80}[.!]*$"
    r"|^(?:is there|can i|could i|may i|would you|do you want|what else|how else)\b[^.!?]{0,80}\?$|^(?:sorry|i apologi[sz]e|apologies|my apologies|i'm sorry|i am sorry|lo siento|désolée?|es tut mir leid)\b[^.!?]{0,25}[.!]*$"
    r"|^(?:sure|certainly|of course|okay|ok|well)\b[^.!?]{0,30}[.!:]*$|^(?:good|great|interesting|an interesting) question[.!]*$",
    re.I,
)
_GREETING = re.compile(r"^(?:(?:hello|hi|hey|hallo|bonjour|hola)[^.!,:]{0,15}[!.,:]\s*|(?:thanks|thank you)[^.!?:]{0,30}[.!:]\s*|(?:regarding|about|as to|concerning|on) (?:your|the|this) (?:question|request|query)\s*[:,.]\s*)+", re.I)
_SENTENCE = re.compile(r"(?<=[.!?。！？])[\"')\]]*\s+|(?<=[。！？])|\n+")


def sentences_of(text: str) -> list[str]:
    return [s.strip() for s in _SENTENCE.split(text) if s and s.strip()]


def is_refusal(body: str) -> bool:
    """Whether the answer declines or says it cannot answer, and says nothing else."""
    text = _GREETING.sub("", body.replace("’", "'").strip())
    refused = False
    for s in sentences_of(text):
        if _refuses(s) and not (_ANSWERS.search(s) and not _REASON.search(s)):
            refused = True
        elif not _FILLER.search(s):
            return False
    return refused


# --- the question given back ----------------------------------------------------

_WORD = re.compile(r"[^\W_]+(?:'[^\W_]+)?")
_BACK = re.compile(r"^\W*(?:(?:thanks|thank you) for (?:asking|the question|your question)|you (?:asked|want to know|are asking)|the question (?:is|was|asks)|your question(?: is| was)?|question|q|frage|pregunta|so)\s*[:.,!?]+\s*", re.I)


def tiles(a: list[str], b: list[str], least: int = 2) -> int:
    """Words of a covered by greedy string tiling with b: the longest common runs first, each word used once."""
    used_a, used_b = [False] * len(a), [False] * len(b)
    where: dict[str, list[int]] = {}
    for j, w in enumerate(b):
        where.setdefault(w, []).append(j)
    covered = 0
    while True:
        best, found = least - 1, []
        for i in range(len(a)):
            if used_a[i]:
                continue
            for j in where.get(a[i], ()):
                k = 0
                while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k] and not used_a[i + k] and not used_b[j + k]:
                    k += 1
                if k > best:
                    best, found = k, [(i, j)]
                elif k == best and k >= least:
                    found.append((i, j))
        if best < least:
            return covered
        for i, j in found:
            if not any(used_a[i : i + best]) and not any(used_b[j : j + best]):
                used_a[i : i + best] = used_b[j : j + best] = [True] * best
                covered += best


_LABEL = re.compile(r"\b(?:answer|antwort|réponse|respuesta)\s*:", re.I)
_PARTS = re.compile(rf"\n+|{_LABEL.pattern}", re.I)
_NO_SPACES = re.compile(r"[\u3040-\u30ff\u3400-\u9fff\u0e00-\u0e7f]")


def _words(text: str) -> list[str]:
    """The words of a text; of scripts without spaces, the characters."""
    said = _WORD.findall(text.lower())
    if not _NO_SPACES.search(text):
        return said
    return [c for w in said for c in (w if _NO_SPACES.search(w) else (w,))]


def copies_question(body: str, query: str) -> bool:
    """Whether the answer is the question, once or again and again, with small changes at most."""
    asked = _words(query)
    if len(asked) < 3:
        return False
    text = _TAG.sub(" ", body)
    if not _LABEL.search(text[: 3 * len(query) + 80]) and 2 * len({*_words(text[: 3 * len(query) + 80])} & {*asked}) < len({*asked}):
        return False  # it does not begin with the question, however long it is
    left = []
    for part in _PARTS.split(text):
        part = _BACK.sub("", _BACK.sub("", part))
        said = _words(part)
        if said:
            left.append(said)
        if left and not _repeats(left[0], asked) and len(left) * len(asked) > 2 * len(asked) + 8:
            return False  # the rest cannot make up for it
    if not left:
        return False
    return all(_repeats(said, asked) for said in left) or _same([w for said in left for w in said], asked)


def _repeats(said: list[str], asked: list[str]) -> bool:
    """Whether said is the question so many times in a row."""
    times = max(1, round(len(said) / len(asked)))
    at = [len(said) * i // times for i in range(times + 1)]
    return all(_same(said[i:j], asked) for i, j in zip(at, at[1:]))


def _same(said: list[str], asked: list[str]) -> bool:
    if len(said) > 1.35 * len(asked) + 2 or len(said) < 0.6 * len(asked) or len({*said} & {*asked}) < 0.5 * len({*asked}):
        return False
    got = tiles(said, asked)
    return got >= 0.8 * len(said) and got >= 0.75 * len(asked)


# --- answers that break off -------------------------------------------------------

_STOPS = ".!?。！？…"
_PAIRS = {")": "(", "]": "[", "}": "{", "”": "“", "»": "«", "』": "『", "」": "「", "）": "（"}
_OPENERS = frozenset(_PAIRS.values())
_TOKEN = re.compile(
    r"(?P<fence>^[ \t]*(?:```+|~~~+)|```)|(?P<tick>`)|(?P<tag></?[A-Za-z][\w-]*(?:\s[^<>\n]*)?/?>)|(?P<item>^[ \t]*(?:[-*•–+]|\d{1,3}[.)]|[A-Za-z][.)])[ \t]+(?=\S))|(?P<row>^[ \t]*\|.*\|[ \t]*$)"
    r"|(?P<quote>\")|(?P<open>[(\[{“«『「（])|(?P<close>[)\]}”»』」）])|(?P<line>\n)|(?P<stop>[.!?。！？…](?=[\s\"')\]}”»』」）]|$))",
    re.M,
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr p li".split())
_ABBREVIATED = re.compile(r"(?:\b(?:e\.g|i\.e|etc|cf|vs|z\.b|bzw|p\.\s?ex|p\.\s?ej|no|fig|approx)|\b[A-Za-z])\.$", re.I)
_STATEMENT = re.compile(r"[\w\"'\])};,]\s*$|[\w.\"'/-]+:\s*$")
_CODE_END = re.compile(r"^\s*(?:[\w.\"'/-]+:(?:\s+\S.*)?|-\s+[\w.-]+:\s.*|[{}\[\]();]+,?|[$#>]\s?\S.*|.*[;{}]|[a-z][\w-]*(?:\s+\S+)*\s--?[\w-]+.*|(?:kubectl|docker|helm|curl|sudo|git|export|cat|apt|yum|pip)\b.*)\s*$")


class Parse:
    """What a pushdown parser finds at the end of a text.

    open: what is still open, outermost first: ``` (a fence), ` (code in a line),
    brackets and quotation marks by their opening sign, <name> (markup), - (a list
    item). since: where each of them began; stop: where the last sentence ended.
    """

    __slots__ = ("open", "since", "stop", "row")

    def __init__(self, text: str):
        stack: list[str] = []
        since: list[int] = []
        self.stop, self.row = 0, False

        def push(sign: str, at: int) -> None:
            stack.append(sign)
            since.append(at)

        def pop_to(depth: int) -> None:
            del stack[depth:], since[depth:]

        for m in _TOKEN.finditer(text):
            kind, said = m.lastgroup, m[0]
            top = stack[-1] if stack else None
            if kind == "fence":
                if "```" in stack:
                    pop_to(stack.index("```"))
                else:
                    push("```", m.start())
            elif "```" in stack:
                continue  # within a fence only its end counts
            elif kind == "line":
                self.row = False
                # a line of its own ends an item, and code, which keeps to its line
                if top == "`":
                    pop_to(len(stack) - 1)
                if "-" in stack and not re.match(r"[ \t]+\S", text[m.end() : m.end() + 40]):
                    pop_to(stack.index("-"))
            elif kind == "tick":
                if top == "`":
                    pop_to(len(stack) - 1)
                else:
                    push("`", m.start())
            elif top == "`":
                continue
            elif kind == "tag":
                name = f"<{re.sub(r'[</>]', ' ', said).split()[0].lower()}>"
                if said.startswith("</"):
                    if name in stack:
                        pop_to(len(stack) - 1 - stack[::-1].index(name))
                elif not said.endswith("/>") and name[1:-1] not in _VOID:
                    push(name, m.start())
            elif kind == "item":
                if "-" in stack:
                    pop_to(stack.index("-"))
                push("-", m.start())
            elif kind == "row":
                self.row = True
            elif kind == "quote":
                if '"' in stack:
                    pop_to(stack.index('"'))
                else:
                    push('"', m.start())
            elif kind == "open":
                push(said, m.start())
            elif kind == "close":
                if _PAIRS[said] in stack:
                    pop_to(len(stack) - 1 - stack[::-1].index(_PAIRS[said]))
            else:
                self.stop = m.end()
        self.open, self.since = stack, since


def is_truncated(body: str, common: frozenset[str] = frozenset()) -> bool:
    """Whether the answer breaks off within a sentence.

    common: frequent words, which end no sentence without a stop. Ends in a list
    item, a row, closed markup, a statement of code or a full stop are complete,
    and so is a short phrase that is all of the answer, unless something that was
    opened is still open or the last word or sign asks for more.
    """
    text = body.rstrip()
    if not text:
        return False
    parse = Parse(text)
    last = text[text.rfind("\n") + 1 :].strip()
    lone = "\n" not in text
    if "```" in parse.open:
        # a fence may be left out, a statement in it may not
        code = text[parse.since[parse.open.index("```")] :].split("\n", 1)
        inner = code[1] if len(code) > 1 else ""
        ends = [x for x in inner.split("\n") if x.strip()]
        return not ends or not _STATEMENT.search(ends[-1]) or any(inner.count(o) > inner.count(c) for c, o in _PAIRS.items() if c in ")]}") or inner.count('"') % 2 == 1
    if last.startswith("```") or last.startswith("~~~"):
        return False
    inner = [(o, at) for o, at in zip(parse.open, parse.since) if o != "-" and not o.startswith("<")]
    markup = [o for o in parse.open if o.startswith("<")]
    end = text.rstrip("\"'”’»)]}*_`』」）")
    word = re.split(r"[\s(\[{\"“]", text)[-1].lower().strip(".,;:")
    dangling = text[-1] in ",;:–([{“«-" or word in common and text[-1] not in _STOPS
    if end and end[-1] in _STOPS:
        # stopped, unless what the last sentence opened is open and the stop may be an abbreviation's
        return bool(inner) and _ABBREVIATED.search(text) is not None
    if parse.row or last.endswith(">") and not markup:
        return False
    if not lone and not inner and _CODE_END.match(last) and not (re.match(r"[A-Za-z]", last) and word in common):
        return False
    if "-" in parse.open and not lone:
        # an item needs no stop where none of its sentences has one
        item = text[parse.since[parse.open.index("-")] :]
        return bool(inner) or text[-1] in ",;([{“«" or re.search(r"[.!?]\s+\S", re.sub(r"^\s*\S+\s+", "", item)) is not None
    if not end:
        return False
    if text[-1] == ":" and not lone and len(last) < 30:
        return False
    if parse.stop or not lone:
        return True
    return dangling or bool(inner) or bool(markup) or len(text.split()) > 8 or re.search(r"[,;:](?! no\b)", text) is not None


# --- languages ---------------------------------------------------------------------


def in_other_language(bodies: list[str], queries: list[str], languages: Languages) -> list[bool]:
    """Of each answer, whether most of what it says, its opening aside, is in another language than the question."""
    asked = languages.of(queries)
    said: list[str] = []
    owner: list[int] = []
    for i, body in enumerate(bodies):
        if asked[i] is not None:
            for s in sentences_of(body):
                if not (len(s) < 60 and _FILLER.match(s)):
                    said.append(s)
                    owner.append(i)
    balance = [0] * len(bodies)
    for s, i, lang in zip(said, owner, languages.of(said)):
        if lang is not None:
            balance[i] += -len(s) if lang == asked[i] else len(s)
    return [b > 0 for b in balance]


def defects_of(answers: list[str | None], queries: list[str | None], citations: list[list[str | None] | None], languages: Languages, common: frozenset[str]) -> list[str | None]:
    """The defect of each answer, or None; a null answer is empty; without a question only the answer is judged."""
    out: list[str | None] = []
    left: list[int] = []
    bodies: list[str] = []
    for i, (answer, query, cited) in enumerate(zip(answers, queries, citations)):
        body = body_of(answer or "", frozenset(c for c in cited if c) if cited else frozenset())
        if is_empty(body):
            out.append("empty")
        elif is_refusal(body):
            out.append("refusal")
        elif query and copies_question(body, query):
            out.append("copies_question")
        elif is_truncated(body, common):
            out.append("truncated")
        else:
            out.append(None)
            if query:
                left.append(i)
                bodies.append(body)
    for i, other in zip(left, in_other_language(bodies, [queries[i] or "" for i in left], languages)):
        if other:
            out[i] = "other_language"
    return out


def with_questions(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """rows with the _query of their _key, null without one.

    Beyond a broadcast, rows without a key stay where they are and every key is
    split, so that a frequent question does not gather its answers in one task.
    """
    if small_enough(asked, BROADCAST_ROWS):
        return rows.join(F.broadcast(asked), "_key", "left")
    known, alone = rows.filter("_key is not null"), rows.filter("_key is null").withColumn("_query", F.lit(None).cast("string"))
    salted = asked.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    met = known.withColumn("_salt", F.pmod(F.xxhash64("_id"), F.lit(SALTS)).cast("int")).join(salted, ["_key", "_salt"], "left")
    return met.select(*rows.columns, "_query").unionByName(alone)


def defective_pairs(answers: DataFrame, queries: DataFrame, common_words: DataFrame, id_col: str = "result_id", answer_col: str = "answer_text", citations_col: str | None = "citations", key_col: str = "query_id", query_col: str = "query_text", lang_col: str = "lang", word_col: str = "word") -> DataFrame:
    """id_col, defect of each defective answer.

    Null and blank answers are empty; a null or unknown key leaves the answer to be
    judged without a question; a key that occurs again keeps its smallest question.
    Languages are those of common_words, their profiles learned from all
    questions. Rows that occur twice come out twice.
    """
    words = [(r[0], r[1]) for r in common_words.select(lang_col, word_col).filter(F.col(lang_col).isNotNull() & F.col(word_col).isNotNull()).distinct().limit(MAX_WORDS + 1).collect()]
    if len(words) > MAX_WORDS:
        raise ValueError(f"more than {MAX_WORDS} common words")
    held = answers.sparkSession.sparkContext.broadcast((learn(queries, query_col, words), frozenset(w.lower() for _, w in words)))

    @arrow_once("string")
    def defect(answer: pa.Array, query: pa.Array, cited: pa.Array) -> pa.Array:
        out: list[str | None] = []
        for at in range(0, len(answer), 512):
            out.extend(defects_of(*(x.slice(at, 512).to_pylist() for x in (answer, query, cited)), *held.value))
        return pa.array(out, pa.string())

    asked = queries.select(F.col(key_col).alias("_key"), F.col(query_col).alias("_query")).filter("_key is not null and _query is not null").groupBy("_key").agg(F.min("_query").alias("_query"))
    cited = F.col(citations_col).cast("array<string>") if citations_col else F.lit(None).cast("array<string>")
    rows = answers.select(F.col(id_col).alias("_id"), F.col(key_col).alias("_key"), F.col(answer_col).alias("_answer"), cited.alias("_cited"))
    joined = with_questions(rows, asked)
    judged = joined.select("_id", defect("_answer", "_query", "_cited").alias("defect"))
    return judged.filter("defect is not null").select(F.col("_id").alias(id_col), "defect")
