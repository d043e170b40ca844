"""Problem 1: defective answers.

Rules are applied in a fixed order and every one that is triggered is emitted: emptiness, refusal,
copied question (whole, as a prefix, or in its words), script or language mismatch, and truncation
(unclosed delimiters, ellipses, a beginning of an evidence sentence that stops early, or an ending
that the corpus's finished sentences don't know). Every item is read once: what the endings are judged
by is counted in the same pass.

Defined results. A null answer is empty. A null question has no language and is never copied. An
item without evidence is judged by its own words. An item delivered twice gives one result. Of
several defects the first in ``ORDER`` is the item's defect in ``found_defects``.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.functions import units as U
from lodegraph.llm import endings as E
from lodegraph.session import cut_lineage

ORDER = ["empty_answer", "refusal", "copied_question", "wrong_language", "truncated_answer"]

# Labels and placeholders that are no content.
_LABEL = re.compile(r"^\s*(?:(?:the\s+)?(?:final\s+)?(?:answer|response|output|reply|a|antwort|réponse|reponse|respuesta)|答案|回答|答|解答)\s*[:：]\s*", re.I)
_PLACEHOLDER = re.compile(r"(?:null|none|nil|nan|n/?a|not applicable|undefined|tbd|todo|empty|blank|unknown|unavailable|placeholder|answer|response|无|暂无|空|略|待定|未知|没有)", re.I)
_QUESTION_LABEL = re.compile(r"^\s*(?:question|q|query|frage|问题|问|题目)\s*[:：]\s*", re.I)

# How answers decline, by language.
_REFUSAL = re.compile(
    r"""(?ix)
    \b(?:cannot|can\s?not|can['’]t|could\s+not|couldn['’]t|unable\s+to|not\s+able\s+to|impossible\s+to|not\s+possible\s+to)\s+(?:be\s+)?(?:help|assist|answer|respond|comply|provide|determined?|answered|inferred?|found|find|established?|concluded?|derived?|say|tell|fulfil\w*)
    |\b(?:i['’]?m|i\s+am|we\s+are)\s+(?:sorry|unable|not\s+able)\b|^\s*(?:sorry|apologies|unfortunately)\b|\bi\s+do(?:n['’]t|\s+not)\s+(?:know|have)
    |\b(?:is|are|was|were)?\s*not\s+(?:\w+\s+)?(?:stated|given|provided|mentioned|specified|reported|available|disclosed|discussed|found|included|enough|sufficient|answerable)\b
    |\b(?:insufficient|inadequate|not\s+enough|no|lacks?|lacking)\s+(?:\w+\s+)?(?:evidence|information|context|data|details?|answer)\b
    |\bevidence\s+(?:\w+\s+){0,3}(?:insufficient|not\s+sufficient|lacking)
    |\b(?:text|passage|context|paper|document|source|evidence|excerpt)\s+(?:\w+\s+)?(?:does|do|did)(?:\s+not|n['’]t)\b
    |无法(?:确定|回答|得出|判断|得知|提供|给出|推断|获知)|不能(?:确定|回答|得出|判断)|没有(?:提供|给出|提及|说明|相关|足够)|未(?:提及|提供|给出|说明|涉及)|不足以|证据不足|信息不足|抱歉|对不起|不知道|不清楚
    |\b(?:kann|können)\s+(?:\w+\s+){0,6}nicht\b|\bnicht\s+(?:genannt|angegeben|erwähnt|bestimm\w+|beantwort\w+|möglich|ausreichend)|\bkeine\s+(?:angaben?|informationen?|antwort)|\bleider\b|\btut\s+mir\s+leid
    |\bne\s+(?:peux|peut|permet\w*|sais|dit|mentionne|précise|contient|fournit)\b|\bimpossible\s+de\b|\bdésolée?\b|\bpas\s+(?:mentionné|indiqué|précisé|suffisant)|\bd['’]informations?\s+insuffisantes?
    |\bno\s+(?:puedo|se\s+puede|se\s+indica|hay\s+(?:suficiente\s+)?informaci[óo]n)|\blo\s+siento
    |не\s+(?:могу|удалось|указано|определить)|к\s+сожалению|недостаточно|申し訳|わかりません|できません|알\s?수\s?없|죄송
    """
)

# An experiment that failed, told with its means or cause, and words for what an answer is taken from.
_FINDING = re.compile(r"(?i)\bcould\s+not\s+be\s+(?:measured|determined|found|established|resolved|observed|inferred|derived|concluded)\b.*?\b(?:by|with|using|since|because|due\s+to|owing\s+to|as)\b")
_OF_THE_TEXT = re.compile(r"(?i)\b(?:text|passage|context|paper|document|source|evidence|excerpt|information|spans?|tables?|figures?|sections?|provided|given|stated|answer)\b")

# The commonest function words of languages in Latin letters.
_ONLY = {
    "en": set("the of and to in is are was were which with by from for on at as that this these its it be been has have had not or but what how why does did than when while above below during".split()),
    "de": set("der die das und ist mit für von dem den des ein eine einen einem einer nicht auch auf bei nach über durch zum zur aus dass als wird wurde werden sich sind war im am".split()),
    "fr": set("le la les des du un une et est pour dans sur avec que qui aux au par ne pas ce cette son sa ses il elle sont était plus".split()),
    "es": set("el los las una y del con para por que se su sus como más pero fue son está entre".split()),
    "it": set("il lo gli della del delle dei una e per con che di da nel nella sono è più non".split()),
    "pt": set("os as uma e para com que do da dos das no na em não são foi mais pelo pela".split()),
    "nl": set("het een en van voor met dat niet naar zijn wordt bij uit ook aan door werd deze".split()),
    "sv": set("och att det som en ett på är av för med den till inte har om vid från".split()),
    "pl": set("i w na z się nie do jest to że od po przez dla jako przy oraz był".split()),
    "tr": set("ve bir bu da de için ile olarak olan çok daha gibi kadar sonra değil".split()),
}
_LANGUAGES: dict[str, list[str]] = {}
for _language, _words in _ONLY.items():
    for _w in sorted(_words):
        _LANGUAGES.setdefault(_w, []).append(_language)
_FAR = re.compile("[^\x00-\u024f]")
_SCRIPTS = {"HAN": "han", "CJK": "han", "HIRAGANA": "kana", "KATAKANA": "kana", "HANGUL": "hangul", "CYRILLIC": "cyrillic", "ARABIC": "arabic", "HEBREW": "hebrew", "DEVANAGARI": "devanagari", "THAI": "thai", "GREEK": "greek"}
_WORD = re.compile(r"[^\W\d_]+")
_HAN_UNIT = re.compile(r"^[^㐀-鿿]*\d[\d.,\s]*[㐀-鿿]{1,6}\s*[。.]?$")


_NO_CONTENT, _MARKS = re.compile(r"(?:[^\w/]|_)+"), re.compile(r"[\W_]+")


def _plain(text: str) -> str:
    return text if text.isascii() else unicodedata.normalize("NFKC", text)


def is_empty(answer: str | None) -> bool:
    if answer is None:
        return True
    text = _LABEL.sub("", _plain(answer))
    core = _NO_CONTENT.sub("", text)
    return not core.strip("/") or _PLACEHOLDER.fullmatch(core) is not None and core.lower() != "0"


def _content(text: str) -> str:
    return _MARKS.sub("", _plain(text).casefold())


def is_copy(question: str | None, answer: str | None) -> bool:
    """The answer says only the question again, once or more, labelled or not."""
    if not question or not answer:
        return False
    q, a = _content(_QUESTION_LABEL.sub("", question)), _content(_QUESTION_LABEL.sub("", _LABEL.sub("", answer)))
    a = re.sub(r"(?:question|问题)(?=" + re.escape(q[:8]) + ")", "", a) if q else a
    if not q or len(q) < 8:
        return False
    if a == q or a.replace(q, "") == "":
        return True
    if len(a) >= 0.8 * len(q) and q.startswith(a) or len(a) <= 1.1 * len(q) and a.startswith(q[: math.ceil(0.8 * len(q))]):
        return True  # a copied prefix and hardly anything else
    qw, aw = _WORD_NUM.findall(_plain(question).casefold()), _WORD_NUM.findall(_plain(_QUESTION_LABEL.sub("", answer)).casefold())
    if len(aw) < 8 or len(qw) < 8:
        return False
    asked, said = set(qw), set(aw)
    inside = sum(w in asked for w in aw) / len(aw)
    covered = sum(w in said for w in qw) / len(qw)
    return inside >= 0.9 and covered >= 0.8


_WORD_NUM = re.compile(r"[㐀-鿿]|[^\W_㐀-鿿]+")


def is_refusal(question: str | None, answer: str | None) -> bool:
    """Declines, or says that the text does not tell; a finding of the experiment, or a measured value of the answer's own, is no refusal."""
    if not answer:
        return False
    text = _plain(answer)
    if not _REFUSAL.search(text) or _FINDING.search(text) and not _OF_THE_TEXT.search(text):
        return False
    asked = _plain(question or "")
    return not any(m["num"] not in asked and any(U.lookup(x) or x.startswith("%") for x in U.labels_after(m["tail"])) for m in U.MEASURE.finditer(text))


def language(text: str | None) -> tuple[str, int]:
    """(language or script of the sentence words, how many words or characters say so)."""
    if not text:
        return "none", 0
    text = _plain(text)
    foreign: dict[str, int] = {}
    for c in _FAR.findall(text):
        if c.isalpha() and (script := _SCRIPTS.get(unicodedata.name(c, "?").split()[0].split("-")[0])):
            foreign[script] = foreign.get(script, 0) + 1
    if foreign.get("kana", 0) >= 2:
        return "kana", foreign["kana"]
    foreign.pop("greek", None) if foreign.get("greek", 0) < 6 else None
    if foreign and (best := max(foreign.items(), key=lambda x: x[1]))[1] >= 4:
        return best
    scores: Counter = Counter()
    for w in _WORD.findall(text.lower()):
        scores.update(_LANGUAGES.get(w, ()))
    best = max(scores.items(), key=lambda x: (x[1], x[0] == "en", x[0])) if scores else ("none", 0)
    return best if best[1] >= 2 else ("none", 0)


def is_foreign(question: str | None, answer: str | None, evidence: str = "") -> bool:
    """Another script or language than the question's: by the function words, or since hardly a word is one of the question, the evidence or their language."""
    if not question or not answer:
        return False
    asked, _ = language(question)
    said, n = language(answer)
    if asked == "none" or asked == said:
        return False
    if said == "none" or said in _ONLY and n < 3:
        if asked not in _ONLY:
            return False
        words = [w for w in _WORD.findall(_plain(answer)) if w.islower() and len(w) > 1]
        home = {w.lower() for w in _WORD.findall(_plain(f"{question} {evidence}"))} | _ONLY[asked]
        return len(words) >= 4 and sum(w in home for w in words) <= 0.25 * len(words) and not any(w in _ONLY[asked] for w in words)
    if said == "han" and _HAN_UNIT.match(_plain(answer)):
        return False
    return n >= 3 or said == "han"


_PAIRS = {")": "(", "]": "[", "}": "{", "）": "（", "】": "【", "」": "「", "”": "“"}


_BRACKETS = re.compile("[" + re.escape("".join([*_PAIRS, *_PAIRS.values()])) + "]")


def unclosed(text: str) -> bool:
    stack: list[str] = []
    for c in _BRACKETS.findall(text):
        if c not in _PAIRS:
            stack.append(c)
        elif stack and stack[-1] == _PAIRS[c]:
            stack.pop()
    return bool(stack)


def stops_early(answer: str, evidence: list[str]) -> bool | None:
    """True if the answer is the beginning of an evidence sentence that goes on, False if it is a whole one."""
    last = E.sentences(E.unmarked(answer.strip()))
    if not last:
        return None
    mine = re.sub(r"\s+", " ", last[-1]).strip(" .。")
    if len(mine) < 8:
        return None
    verdict = None
    for text in evidence:
        for sentence in E.sentences(re.sub(r"\s+", " ", text)):
            if sentence.startswith(mine):
                if not sentence[len(mine) :].strip(" .。!?！？"):
                    return False
                verdict = True
    return verdict


def features(question: str | None, answer: str | None, evidence: list[str]) -> tuple[list[str], str, E.Frame | None]:
    """(defects that need no counts, truncation state, frame to be counted)."""
    if is_empty(answer):
        return ["empty_answer"], "no", None
    defects = [name for name, hit in (("refusal", is_refusal(question, answer)), ("copied_question", is_copy(question, answer)), ("wrong_language", is_foreign(question, answer, " ".join(evidence)))) if hit]
    end = E.ending(answer)
    if end.state == "marked" or unclosed(answer):
        return defects, "yes", None
    if end.state in ("none", "closed"):
        return defects, "no", None
    tokens = _WORD_NUM.findall(end.last)
    if len(tokens) <= 8 and re.match(r"\s*[≈~约]?\s*[-+]?\d", end.last):
        return defects, "no", None  # a value and unit
    early = stops_early(answer, evidence)
    if early is not None:
        return defects, "yes" if early else "no", None
    if E.hardly_begun(end.last, answer) or E.goes_on_elsewhere(end.last, "\n".join([question or "", *evidence, answer])):
        return defects, "yes", None
    return defects, "ask", end.frame


def _evidence(items: DataFrame):
    return F.coalesce(F.array_join(F.filter(F.transform("evidence_spans", lambda s: s["content"]), lambda c: c.isNotNull()), "\x1e"), F.lit(""))


FRAME = ["language", "opener", "tail", "kind", "closer"]


def summed(frames: DataFrame) -> DataFrame:
    """(language, opener, tail, kind, closer, n) of every kind of finished sentence."""
    return frames.groupBy(*FRAME).agg(F.sum("n").alias("n"))


def with_judgement(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """Adds ``cut`` to rows that have the columns of a frame (null frames give null)."""
    counts = cut_lineage(counts)  # grouped three ways below
    closers = counts.groupBy("language", "closer").agg(F.sum("n").alias("closer_n"))
    openers = counts.groupBy("language", "opener").agg(F.sum("n").alias("opener_n"))
    frames = counts.groupBy("language", "opener", "tail", "kind").agg(F.sum("n").alias("frame_n"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    joined = rows.join(closers, ["language", "closer"], "left").join(openers, ["language", "opener"], "left").join(frames, ["language", "opener", "tail", "kind"], "left")
    c, o, f = (F.coalesce(x, F.lit(0)) for x in ("closer_n", "opener_n", "frame_n"))
    return joined.withColumn("cut", (c < max(E.CLOSERS, total * E.CLOSER_SHARE)) | ((o >= E.OPENERS) & (f <= o * E.RARE_FRAME)))


def defects(items: DataFrame) -> DataFrame:
    """(qid, defects): every item with all the defects that its answer triggers, in order; none for a sound one."""
    base = items.where("qid is not null").select("qid", "question", "answer", _evidence(items).alias("evidence"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            counts: E.Counter = E.Counter()
            rows = []
            for qid, q, a, ev in zip(b["qid"], b["question"], b["answer"], b["evidence"]):
                evidence = [x for x in ev.split("\x1e") if x]
                for text in (a, *evidence):
                    counts.update(E.finished(text))
                found, state, f = features(q, a, evidence)
                rows.append((qid, "|".join(found), state, *(f or (None,) * 5), None))
            rows += [(None, None, None, *f, n) for f, n in counts.items()]
            yield pd.DataFrame(rows, columns=["qid", "found", "state", *FRAME, "n"])

    both = cut_lineage(base.mapInPandas(run, f"qid string, found string, state string, {', '.join(f'{c} string' for c in FRAME)}, n bigint"))  # the texts are read only once
    counts = summed(both.where("n is not null").select(*FRAME, "n"))
    rows = both.where("n is null").drop("n").dropDuplicates(["qid"])
    sure = rows.where("state != 'ask' or closer is null").select("qid", "found", (F.col("state") == "yes").alias("cut"))
    asked = with_judgement(rows.where("state = 'ask' and closer is not null"), counts).select("qid", "found", "cut")
    every = F.array_compact(F.array_append(F.filter(F.split("found", r"\|"), lambda x: x != ""), F.when(F.col("cut"), F.lit("truncated_answer"))))
    return sure.unionByName(asked).select("qid", every.alias("defects"))


def found_defects(items: DataFrame) -> DataFrame:
    return defects(items).where(F.size("defects") > 0).select("qid", F.col("defects")[0].alias("defect"))
