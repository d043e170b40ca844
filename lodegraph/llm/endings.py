"""How sentences of a corpus end, and whether an unfinished last sentence is cut off.

The model is counted over every finished sentence of the whole corpus: which words or kinds of token
close one, and which closings follow which kind of opening. A last sentence without a full stop is
complete if its last word closes sentences elsewhere and its frame does; else it was cut. Frames are
made of function words, so the table of frames grows with the language; the table of closers holds last words.
"""

from __future__ import annotations

import re
from collections import Counter
from typing import NamedTuple

#: A closing word must close so many finished sentences, and this share of all; a frame is judged if its opening has so many.
CLOSERS, CLOSER_SHARE, OPENERS, RARE_FRAME = 2, 1e-6, 20, 0.001

# Function words of English, German and French.
_FUNCTION = set(
    "a an the of in on at by to from with for as and or but nor because although while when if than that this these those its his her their our is are was were be been being has have had does do did not no neither into over under above below after before during past near along across between within without about against until once so then which who whose it we they he she you i there here unlike since through per via"
    " der die das den dem des ein eine einen einem einer eines und oder aber weil dass wenn als mit von zu zum zur im am an auf aus bei nach vor über unter für durch um bis ohne gegen ist sind war wird werden wurde hat haben nicht kein keine noch nur auch sich es sie er wir ich diese dieser dieses"
    " le la les un une des du de et ou mais car que qui dont où en dans sur sous avec sans pour par vers chez au aux ce cette ces son sa ses leur est sont était été ne pas plus se il elle nous vous ils elles".split()
)
_TOKEN = re.compile(r"[^\W_]+(?:[-'’/.,·][^\W_]+)*[%°²³⁻¹]*|[°℃℉µ]\S*|[,;:，；：、]")
_HAN = re.compile(r"[㐀-鿿]")
_STOP = re.compile(r"(?<=[.!?])[\"'”’)\]]*(?=\s|$)|(?<=[。！？])[”’）」]*|\n+")
_MARK = re.compile(r"(?:\s*(?:\[\s*(?:\.\.\.|…)\s*\]|\(\s*(?:\.\.\.|…)\s*\)|…+|\.{3,}|。{3,}|�+))+\s*$")
_CLOSED = re.compile(r"[.!?。！？][\"'”’）)\]」]*$")
_ABBREVIATED = re.compile(r"(?:^|[\s(])(?:Fig|Figs|Eq|Eqs|Tab|No|Vol|vs|ca|cf|e\.g|i\.e|al|Abb|Nr|z\.B)\.$|\s(?:at|of|to|reaches|by|bei|mit|etwa|auf|vaut|atteint|à)\s\d+\.$")


def unmarked(text: str) -> str:
    """A text without the ellipses or broken characters at its end."""
    while (tail := text[-80:]) and (rest := _MARK.sub("", tail)) != tail:
        text = text[: len(text) - len(tail)] + rest
    return text


class Frame(NamedTuple):
    language: str  # "han" or "letters"
    opener: str
    tail: str
    kind: str
    closer: str


def _kind(token: str, before: str | None) -> tuple[str, str]:
    """(kind, closer) of a last token."""
    if token in ",;:，；：、":
        return "comma", token
    if before and re.fullmatch(r"[-+]?\d+(?:[.,]\d+)*", before) and not token[0].isdigit():
        return "#u", f"#u:{token if len(token) < 24 else '?'}"
    if re.fullmatch(r"[-+]?\d+(?:[.,]\d+)*", token):
        return "#n", "#n"
    if m := re.fullmatch(r"\d+(?:[.,]\d+)*([A-Za-zµμ°℃℉%²³/⁻¹·.]{1,20})", token):
        if not re.search(r"\d", m[1]) and (m[1].islower() or len(m[1]) <= 5):
            return "#u", f"#u:{m[1]}"
    if any(c.isdigit() for c in token):
        if m := re.fullmatch(r"([^\W\d_]{3,})-(\d{1,3})", token):
            return "name-#", "name-#"
        return "id", f"id:{'-' if '-' in token else ''}{min(len(token), 16)}"
    if len(token) == 1 and token.isupper():
        return "letter", f"letter:{token}"
    if token[0].isupper() and not token.isupper():
        return "name", "name"
    if token.isupper() and len(token) > 1:
        return "caps", "caps"
    return "word", token if len(token) < 30 else "?"


def frame(sentence: str) -> Frame | None:
    """Opening and closing of one sentence, without its full stop."""
    sentence = sentence.strip().rstrip(".!?。！？\"'”’)]）」 ")
    if not sentence.isascii() and (len(_HAN.findall(sentence)) * 4 >= len(sentence) or _HAN.search(sentence[-2:])) or not sentence:
        clauses = re.split(r"[，；,;]", sentence)
        first, last = sentence[:1], clauses[-1]
        opener = first if _HAN.match(first) else "*"
        head = next((c for c in last if _HAN.match(c)), "*")
        if _HAN.match(sentence[-1:]):
            two = sentence[-2:]
            closer = two if _HAN.match(two[:1]) else f"#{sentence[-1]}"
            kind = "han" if _HAN.match(two[:1]) else closer
        else:
            tokens = _TOKEN.findall(re.sub(r"[㐀-鿿]+", " ", last))
            if not tokens:
                return None
            kind, closer = _kind(tokens[-1], tokens[-2] if len(tokens) > 1 else None)
        return Frame("han", opener, f"{min(len(clauses), 4)}{head if len(clauses) > 1 else '-'}", kind, closer)
    tokens = _TOKEN.findall(sentence)
    if not tokens:
        return None
    function = [low for t in tokens if (low := t.lower()) in _FUNCTION and (low == t or t[1:].islower() or len(t) == 1)]
    first = tokens[0].lower()
    lead = first if first in _FUNCTION else "*"
    rest = function[1:] if lead != "*" else function
    kind, closer = _kind(tokens[-1], tokens[-2] if len(tokens) > 1 else None)
    return Frame("letters", f"{lead} {rest[0] if rest else '-'}", " ".join(function[-2:]), kind, closer)


def sentences(text: str) -> list[str]:
    return [s for s in (x.strip() for x in _STOP.split(text)) if s]


def finished(text: str | None, parts: list[str] | None = None) -> list[Frame]:
    """Frames of the finished sentences of a text (``parts`` if they are known)."""
    if not text:
        return []
    out = []
    for s in sentences(text) if parts is None else parts:
        end = s[-40:]
        if _CLOSED.search(end) and not _ABBREVIATED.search(end) and not _MARK.search(end) and (f := frame(s)):
            out.append(f)
    return out


class Ending(NamedTuple):
    state: str  # "closed", "open", "marked" (ellipsis or broken character inside a sentence) or "none"
    last: str
    frame: Frame | None


def _last_sentence(core: str) -> str:
    """The last of a text's sentences, looked for from its end."""
    reach = 256
    while reach < len(core):
        tail = core[-reach:]
        parts = sentences(tail)
        if len(parts) > 1 and len(parts[-1]) < reach - 16:
            return parts[-1]
        reach *= 4
    return sentences(core)[-1]


def ending(text: str | None) -> Ending:
    """The last sentence of a text and how it stands."""
    if not text or not text.strip():
        return Ending("none", "", None)
    core = text.strip()
    bare = unmarked(core)
    marked = bare != core
    core = bare.rstrip()
    if not core:
        return Ending("none", "", None)
    last = _last_sentence(core)
    if _CLOSED.search(core[-64:]) and not _ABBREVIATED.search(core[-64:]):
        return Ending("closed", last, None)
    return Ending("marked" if marked else "open", last, frame(last))


def hardly_begun(last: str, text: str) -> bool:
    """Whether an open last sentence is one or two words (or two characters of Han) after a finished sentence in the same line."""
    core = unmarked(text.strip()).rstrip()
    before = core[: len(core) - len(last)].rsplit("\n", 1)[-1].rstrip()
    if not before or not core.endswith(last) or not _CLOSED.search(before):
        return False
    han = _HAN.findall(last)
    return len(last) <= 2 if han else len(_TOKEN.findall(last)) <= 2


_ALNUM = re.compile(r"[^\W_]+(?:-[^\W_]+)*")


def goes_on_elsewhere(last: str, text: str) -> bool:
    """Whether the last word of an open sentence occurs in the text only as the beginning of something longer."""
    tokens = _ALNUM.findall(re.sub(r"[㐀-鿿]+", " ", last))
    if not tokens or not last.endswith(tokens[-1]) or len(tokens[-1]) < 3 or tokens[-1].isdigit():
        return False
    word = tokens[-1]
    at, longer, whole = text.find(word), 0, 0
    end = len(text.rstrip()) - len(word)
    followers: Counter = Counter()
    while at >= 0:
        if at < end and (at == 0 or not (text[at - 1].isalnum() and text[at - 1].isascii())):
            after = text[at + len(word) : at + len(word) + 24]
            if after[:1].isalnum() and after[:1].isascii() or after[:1] == "-" and after[1:2].isalnum():
                longer += 1
            else:
                whole += 1
                followers[m[1] if (m := re.match(r" ([a-z]{3,})\b", after)) else ""] += 1
        at = text.find(word, at + 1)
    if longer and not whole:
        return True
    # a name that is always followed by the same noun
    return word[0].isupper() and word[1:].islower() and whole > 0 and len(followers) == 1 and "" not in followers and next(iter(followers)) not in _FUNCTION
