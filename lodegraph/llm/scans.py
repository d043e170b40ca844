"""Problem 4: noise in text from scanned pages, found and repaired.

Running headers (lines that show the paper's title, venue or authors) and page numbers are taken
out, then the lines are joined into one character stream. Around every token that the corpus's
vocabulary doesn't know and every hyphen at a line end, the stream is decoded with the known words
next to it: a Viterbi search over segmentations in which a piece may be a known word, a known word
seen through misread letters, two words run together or one word torn apart, each at a cost; a
hyphen at a line end is dropped if the joined word is likelier than the compound. Code, formulas and
markup are held back and put in again unchanged. Paragraph boundaries are chosen over all line ends
by dynamic programming.

The vocabulary holds words that at least SHARE of all blocks contain, so it has at most
(words per block) / SHARE entries, whatever the size of the data.

Defined results. Null and empty texts have no noise and stay as they are. Blocks whose paper is
unknown can have page numbers, hyphens and misread letters, but no headers. Words that contain
digits they can't be misread from, invented names and codes are left alone. A block delivered twice
gives one result. Of equally likely readings the shortest change wins, then the first in order.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHARE, LEAST = 0.0002, 4
#: A capitalised word counts as a word, not a name, if so many blocks begin a sentence with it.
CAPITAL_SHARE = 0.03
#: How much more frequent a word must be than the form taken for its misreading.
ODDS = 25
#: A vocabulary larger than this is cut at a higher share of the blocks before it is sent to every task.
MAX_VOCABULARY = 500_000

# How letters are misread, as (seen, meant).
CONFUSIONS = [
    ("0", "o"), ("1", "l"), ("1", "i"), ("5", "s"), ("9", "g"), ("8", "b"), ("6", "b"), ("c", "e"), ("e", "c"), ("cl", "d"), ("d", "cl"), ("rn", "m"), ("m", "rn"),
    ("ii", "u"), ("u", "ii"), ("li", "h"), ("h", "li"), ("b", "h"), ("h", "b"), ("m", "in"), ("in", "m"), ("m", "ni"), ("ni", "m"), ("nn", "m"), ("vv", "w"), ("w", "vv"), ("f", "t"), ("l", "t"),
    ("t", "l"), ("t", "f"), ("l", "i"), ("i", "l"), ("q", "g"), ("g", "q"), ("n", "u"), ("u", "n"), ("v", "y"), ("y", "v"), ("a", "o"), ("o", "a"), ("fi", "h"), ("|", "l"), ("|", "i"), ("!", "l"), ("!", "i"), ("$", "s"), ("é", "e"), ("ö", "o"), ("€", "e"), ("@", "a"),
]
_BY_SEEN: dict[str, list[str]] = {}
for _seen, _meant in CONFUSIONS:
    _BY_SEEN.setdefault(_seen, []).append(_meant)
_DIGITS = set("015689")

_MARKUP = re.compile(r"<[^<>\n]*>|&#?\w+;|\\[A-Za-z]+\*?|\$[^$\n]*\$|\\\([^)\n]*\\\)|\{\{[^{}]*\}\}|\]\([^)\n]*\)|`[^`\n]*`|\[\[(?:[^\[\]|]*\|)?|https?://\S+|\{[^{}\n]*\}")
_CODE = re.compile(r"```.*?(?:```|\Z)|<pre>.*?(?:</pre>|\Z)|\\begin\{(?:equation|align)\*?\}.*?\\end\{(?:equation|align)\*?\}|\$\$.*?\$\$", re.S)
#: Code, formulas and markup are held back while the text around them is read.
_MASKED = re.compile(f"{_CODE.pattern}|{_MARKUP.pattern}|[\ue000\ue001]", re.S)
_HELD = re.compile("\ue000(\\d+)\ue001")
_WORD = re.compile(r"[a-z]{2,}(?:-[a-z]{2,})*")
_PAGE = re.compile(r"^[\W_]*(?:(?:page|pag\.?|pp?\.?|seite|s\.|第)\s*)?(?P<n>\d{1,4})\s*(?:(?:of|/|von|sur|de)\s*\d{1,5})?\s*页?[\W_]*$", re.I)
_PAGE_EDGE = re.compile(r"^(?P<a>\d{1,4})(?:\s{2,}|\s*[|·—–-]\s+|\t)(?P<b>\S.*)$|^(?P<c>.*\S)(?:\s{2,}|\s+[|·—–-]\s*|\t)(?:p\.?\s*)?(?P<d>\d{1,4})$")
_HYPHENS = "-\u2010\u2011\u00ad\u00ac"
_NAME_OR_CODE = re.compile(r"[A-Z]-\w|[A-Z][a-z]{2,}-\d{1,3}$|\d{3}|[A-Z]\w*\d\w*[A-Z]|[A-Z0-9-]+$")
_EDGE = ".,;:()[]\"'“”‘’*_?…>#=~+/（）。，；：、"


def _fold(text: str) -> str:
    return re.sub(r"\s+", " ", unicodedata.normalize("NFKC", text)).strip().casefold()


# ---- vocabulary ------------------------------------------------------------------------------------------------


def _visible(text: str) -> str:
    return _MARKUP.sub(" ", _CODE.sub(" ", text))


def block_words(text: str) -> set[str]:
    """The distinct words of a block; words that begin a sentence with a capital are marked."""
    text = _visible(text)
    out = {w for w in text.split() if w.isascii()}
    words = set()
    for w in out:
        w = w.strip(_EDGE)
        if _WORD.fullmatch(w):
            words.add(w)
        elif "-" in w and _WORD.fullmatch(w[0].lower() + w[1:]):
            words.add(w.lower())  # a compound that begins a sentence
        elif len(w) > 1 and w[0].isupper() and w[1:].islower() and w.isalpha():
            words.add("^" + w.lower())
    return words


def word_counts(blocks: DataFrame) -> DataFrame:
    """(word, n): in how many text blocks each word occurs; the word "" counts the blocks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            counts: Counter = Counter()
            for text in b["content"]:
                counts.update(block_words(text))
                counts[""] += 1
            yield pd.DataFrame(list(counts.items()), columns=["word", "n"])

    return blocks.where("modality = 'text' and content is not null").select("content").mapInPandas(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


class Vocabulary:
    """Word frequencies with the search for words behind misread letters."""

    def __init__(self, counts: dict[str, int]) -> None:
        self.blocks = max(1, counts.get("", 1))
        low = max(LEAST, self.blocks * SHARE)
        self.count = {w: n for w, n in counts.items() if w and w[0] != "^" and n >= low}
        for w, n in counts.items():
            if w[:1] == "^" and n >= max(LEAST, self.blocks * CAPITAL_SHARE):
                self.count[w[1:]] = self.count.get(w[1:], 0) + n
        self.rare = {w: n for w, n in counts.items() if w}
        self.longest = max(map(len, self.count), default=1)
        self.beginnings = {w[:n] for w in self.count for n in range(len(w) + 1)}
        self.verdicts: dict[str, tuple[tuple[str, int] | None, int]] = {}

    def __contains__(self, word: str) -> bool:
        return word in self.count

    def cost(self, word: str) -> float:
        return math.log(self.blocks + 1) - math.log(min(self.count[word], self.blocks))

    def behind(self, seen: str, most: int = 4) -> tuple[str, int] | None:
        """(word, misread letters) that ``seen`` most likely stands for with at most ``most`` such letters, or None."""
        if seen in self.verdicts:
            known, tried = self.verdicts[seen]
            if known or most <= tried:
                return known if known and known[1] <= most else None
        best, mine = None, self.rare.get(seen, 0) + self.rare.get("^" + seen, 0)
        # (place in what is seen, what is meant so far): only beginnings of known words go on
        level = {(0, "")}
        for changes in range(most + 1):
            reached: set[tuple[int, str]] = set()
            grown: set[tuple[int, str]] = set()
            todo = list(level)
            while todo:
                at, meant = todo.pop()
                if (at, meant) in reached:
                    continue
                reached.add((at, meant))
                if at < len(seen) and (further := meant + seen[at]) in self.beginnings:
                    todo.append((at + 1, further))
                for size in (1, 2):
                    for letters in _BY_SEEN.get(seen[at : at + size], ()) if at + size <= len(seen) else ():
                        if (further := meant + letters) in self.beginnings:
                            grown.add((at + size, further))
            hits = [(self.count[w], w) for at, w in reached if at == len(seen) and w != seen and self.count.get(w, 0) >= max(LEAST, ODDS * mine)]
            if changes and hits:
                best = (max(hits)[1], changes)
                break
            level = grown
        if len(self.verdicts) > 200_000:
            self.verdicts.clear()
        self.verdicts[seen] = best, most
        return best


def load_vocabulary(counts: DataFrame) -> dict[str, int]:
    """The frequent words and the rarer forms that may be misreadings of them, bounded by SHARE."""
    blocks = counts.where("word = ''").first()
    total = blocks["n"] if blocks else 0
    least = max(2, total * SHARE / 4)
    while counts.where(F.col("n") >= least).count() > MAX_VOCABULARY:
        least *= 2
    rows = counts.where(F.col("n") >= least).toPandas()
    return dict(zip(rows["word"], rows["n"].tolist())) | {"": int(total)}


# ---- lines -----------------------------------------------------------------------------------------------------


class Marks:
    """What the running headers of one paper can show."""

    def __init__(self, title: str | None, venue: str | None, authors: str | None) -> None:
        self.title, self.venue = _fold(title or ""), _fold(venue or "")
        self.names = [s for a in (authors or "").split(";") if (s := _fold(a.split(",")[0]))]
        self.authors = _fold(authors or "")

    def header(self, line: str) -> bool:
        line = _fold(line).strip(" -–—|·/")
        if len(line) < 3:
            return False
        if self.venue and (line == self.venue or (len(self.venue) >= 8 and self.venue in line and len(line) <= len(self.venue) + 60)):
            return True
        if self.title and (line == self.title or (len(line) >= min(16, len(self.title)) and self.title.startswith(line)) or (len(self.title) >= 8 and self.title in line and len(line) <= len(self.title) + 30)):
            return True
        if self.authors and line == self.authors:
            return True
        bare = re.sub(r"\bet al\.?|\band\b|&|\b[a-z]\.|[,;./|]", " ", line).split()
        return bool(bare) and bool(self.names) and all(w in self.names for w in bare)


def line_kinds(text: str, marks: Marks) -> list[tuple[str, set[str]]]:
    """(line, noise) of each line; a line without noise is text."""
    lines = text.split("\n")
    filled = sum(1 for x in lines if x.strip())
    out = []
    for line in lines:
        bare, noise = line.strip(), set()
        if bare and filled > 1:
            if _PAGE.match(bare):
                noise.add("page_number")
            elif marks.header(bare):
                noise.add("running_header")
                m = _PAGE_EDGE.match(bare)
                if m and marks.header(m["b"] or m["c"]):
                    noise.add("page_number")
            elif (m := _PAGE_EDGE.match(bare)) and marks.header(m["b"] or m["c"]):
                noise |= {"running_header", "page_number"}
        out.append((line, noise))
    return out


_LEFT = re.compile(rf"(?P<w>[^\W\d_]+)(?P<m>[{re.escape(_HYPHENS)}])$")
_RIGHT = re.compile(r"^(?:>\s*)?(?P<w>[^\W\d_]+)")


def split_word(left: str, right: str) -> tuple[str, str, str] | None:
    """(first half, mark, second half) of what may be one word over a line end, or None."""
    a, b = _LEFT.search(left.rstrip()), _RIGHT.match(right.lstrip())
    if not a or not b:
        return None
    before = left.rstrip()[: a.start()]
    if before and (before[-1].isalnum() or before[-1] in _HYPHENS) and not before[-1].isalpha():
        return None  # part of a code
    rest = right.lstrip()[b.end() :]
    if rest[:1].isdigit() or len(a["w"]) == 1 and a["w"].isupper():
        return None
    return a["w"], a["m"], b["w"]


# ---- decoding --------------------------------------------------------------------------------------------------

CHANGE, JOIN, CUT, COMPOUND, UNKNOWN = 3.0, 3.5, 4.5, 9.0, 16.0
#: Breaks within a stream: a space or line end, a mark at a line end that may belong to the word, one that can't.
SPACE, MARK, SOFT = " ", "\x1e", "\x1f"
_BREAKS = re.compile(f"[{SPACE}{MARK}{SOFT}]")


def suspicious(token: str, vocabulary: Vocabulary) -> str | None:
    """The part of a token to be decoded, or None if it is a known word, a number, a name or a code."""
    word = token.strip(_EDGE)
    if len(word) < 2 or word in vocabulary:
        return None
    lower = word.lower()
    if lower in vocabulary and word[1:].islower():
        return None
    if _NAME_OR_CODE.match(word):
        return None
    letters = sum(c.isalpha() for c in word)
    if letters < 2 or any(c.isdigit() and c not in _DIGITS for c in word) or not word.isascii():
        return None
    if re.match(r"\d{2}", word) or any(c.isupper() for c in word[1:]) or (word[0].isupper() and not any(c.isdigit() for c in word[1:]) and vocabulary.behind(lower) is None):
        return None
    if not all(c.isalnum() or c in "|!$@-" for c in word):
        return None
    if "-" in word and all(p in vocabulary for p in lower.split("-")):
        return None
    return word


class Piece(NamedTuple):
    """One word of a decoded stream: its place there, its reading, the letters undone and the line marks dropped."""

    start: int
    end: int
    shown: str
    changed: int
    dropped: bool


def _readings(piece: str, capital: bool, whole: bool, room: float, vocabulary: Vocabulary) -> Iterator[tuple[float, str, int, bool]]:
    """(cost, reading, misread letters, whether a line mark is dropped) of a piece; readings that cost more than ``room`` may be left out."""
    breaks = _BREAKS.findall(piece)
    spaces = breaks.count(SPACE)
    marks = len(breaks) - spaces
    word = _BREAKS.sub("", piece) if breaks else piece
    torn = JOIN * spaces
    if word in vocabulary:
        yield vocabulary.cost(word) + torn, word, 0, marks > 0
    elif len(word) > 2 and room - torn >= CHANGE and (found := vocabulary.behind(word, min(4, int((room - torn) / CHANGE)))):
        yield vocabulary.cost(found[0]) + CHANGE * found[1] + torn, found[0], found[1], marks > 0
    if breaks == [MARK]:
        x, y = piece.split(MARK)
        compound = f"{x}-{y}"
        if apart := vocabulary.rare.get(compound, 0):
            yield math.log(vocabulary.blocks + 1) - math.log(min(apart, vocabulary.blocks)), compound, 0, False
        if x in vocabulary and y in vocabulary:
            yield min(vocabulary.cost(x) + vocabulary.cost(y) + COMPOUND, UNKNOWN - 1), compound, 0, False
        elif capital:
            yield UNKNOWN - 1, compound, 0, False
    if whole and not spaces:
        yield UNKNOWN, word, 0, marks > 0


def decode(stream: str, vocabulary: Vocabulary, capitals: frozenset[int] = frozenset()) -> tuple[float, list[Piece]]:
    """(cost, words) of the likeliest reading of a short stream of letters and breaks; ``capitals`` are places of capital letters.

    What the parts between spaces cost by themselves bounds the search: no better reading is lost."""
    n = len(stream)
    bound, spent = [math.inf] * (n + 1), 0.0
    if SPACE in stream:
        for m in re.finditer(f"[^{SPACE}]+", stream):
            spent += decode(m[0], vocabulary, frozenset(i - m.start() for i in capitals))[0]
            bound[m.start() + 1 : m.end() + 1] = [spent + 1e-6] * len(m[0])
    best: list[tuple[float, Piece | None]] = [(0.0, None)] + [(math.inf, None)] * n
    reach = max(vocabulary.longest + 4, max(map(len, stream.split(SPACE)), default=0))
    ends = {i for i in range(n) if stream[i] == SPACE} | {n}
    for i in range(n):
        if best[i][0] == math.inf:
            continue
        if stream[i] == SPACE and best[i][0] < best[i + 1][0]:
            best[i + 1] = (best[i][0], Piece(i, i + 1, "", 0, False))
        if _BREAKS.match(stream[i]):
            continue
        start_cost = best[i][0] + (CUT if i and stream[i - 1] != SPACE else 0.0)
        size = 0
        for j in range(i + 1, n + 1):
            if _BREAKS.match(stream[j - 1]):
                continue
            size += 1
            if size > reach:
                break
            piece = stream[i:j]
            mark = piece.find(MARK)
            room = bound[j] - start_cost - (0.0 if j in ends else CUT)
            if room == math.inf:
                room = UNKNOWN - start_cost - (0.0 if j in ends else CUT)
            for cost, shown, changed, dropped in _readings(piece, mark >= 0 and i + mark + 1 in capitals, j in ends, room, vocabulary):
                if start_cost + cost < best[j][0] - 1e-9:
                    best[j] = (start_cost + cost, Piece(i, j, shown, changed, dropped))
    out, at = [], n
    while at > 0:
        piece = best[at][1]
        if piece.shown:
            out.append(piece)
        at = piece.start
    return best[n][0], out[::-1]


class Token:
    """A token of a line, split into what may be decoded and what stands around it."""

    def __init__(self, line: int, at: int, text: str, alone: bool, core: str | None) -> None:
        self.line, self.at, self.text, self.core = line, at, text, core
        self.odd = core is not None
        self.glued = not alone  # markup stands between the token before and this one
        self.mark = ""  # the line-end mark after the core
        if core is not None:
            self.around(text.index(core), text.index(core) + len(core))

    def around(self, start: int, end: int) -> None:
        self.before, self.core, self.after = self.text[:start], self.text[start:end], self.text[end:]


_PARTS = re.compile(r"(?:\s|\ue000\d+\ue001)+|[^\s\ue000]+")


def _known(token: Token, vocabulary: Vocabulary) -> bool:
    word = token.text.strip(_EDGE)
    if not word or not (word.lower() in vocabulary and (word.islower() or word[1:].islower() or len(word) == 1)):
        return False
    token.around(token.text.index(word), token.text.index(word) + len(word))
    return True


def read_words(lines: list[str], vocabulary: Vocabulary) -> tuple[list[str], set[str]]:
    """The lines with misread, torn, merged and hyphenated words repaired, and the noise found.

    Around each unknown token and each line-end hyphen, the tokens next to it are decoded with it as one stream."""
    splits = {i: x for i in range(len(lines) - 1) if lines[i].rstrip()[-1:] in _HYPHENS and lines[i].strip() and lines[i + 1].strip() and (x := split_word(lines[i], lines[i + 1]))}
    texts = [_HELD.sub(" ", x).split() for x in lines]
    odd = {t: w for t in {t for x in texts for t in x} if (w := suspicious(t, vocabulary))}
    if not odd and not splits:
        return lines, set()
    parts = [_PARTS.findall(x) for x in lines]
    stream: list[Token | None] = []  # None parts what can't be one word
    for i, line in enumerate(parts):
        first = True
        if not line or not any(x.strip() for x in line):
            stream.append(None)
        for k, x in enumerate(line):
            if x[0].isspace() or x[0] == "\ue000":
                if not x.isspace():
                    stream.append(None)
                continue
            if first and i - 1 in splits and x == ">":
                parts[i][k] = ""
                continue
            token = Token(i, k, x, True, odd.get(x))
            if first and i - 1 in splits and stream and stream[-1] is not None and stream[-1].mark:
                at = x.index(splits[i - 1][2])
                if x.startswith(">"):
                    token.text = x = x[at:]
                    at = 0
                token.around(at, at + len(splits[i - 1][2]))
                token.odd = True
            first = False
            stream.append(token)
        last = stream[-1] if stream else None
        if i in splits and last is not None and last.line == i:
            x, mark, _ = splits[i]
            start = len(last.text) - 1 - len(x)
            if start >= 0 and (last.core is None or last.text[:start] == "" or not last.odd or last.text in odd):
                last.around(start, start + len(x))
                last.mark, last.after, last.odd = mark, "", True
    noise: set[str] = set()
    wanted = [t is not None and t.odd for t in stream]
    k = 0
    while k < len(stream):
        if not wanted[k]:
            k += 1
            continue
        first = k
        if k and stream[k - 1] is not None and not stream[k].before and _known(stream[k - 1], vocabulary) and not stream[k - 1].after:
            first = k - 1
        window = stream[first : k + 1]
        k += 1
        while k < len(stream) and stream[k] is not None and not window[-1].after and (window[-1].mark or window[-1].odd or wanted[k]):
            if not (wanted[k] or _known(stream[k], vocabulary)) or (stream[k].before and not window[-1].mark):
                break
            window.append(stream[k])
            k += 1
        _read_window(window, parts, vocabulary, noise)
    return ["".join(x).strip() if x else "" for x in parts], noise


def _read_window(window: list[Token], parts: list[list[str]], vocabulary: Vocabulary, noise: set[str]) -> None:
    """Decodes the tokens and writes what differs into the parts of their lines."""
    raw, starts = "", []
    for t in window:
        starts.append(len(raw))
        raw += t.core + (SPACE if not t.mark else SOFT if t.mark in "\u00ad\u00ac" else MARK)
    ends = [s + len(t.core) for s, t in zip(starts, window)]
    raw = raw[: ends[-1]]
    lower = "".join(c.lower() if len(c.lower()) == 1 else c for c in raw)
    _, pieces = decode(lower, vocabulary, frozenset(i for i, c in enumerate(raw) if c.isupper()))
    k = 0
    while k < len(window):
        own, last = [], k
        while pieces and pieces[0].start < ends[last]:
            own.append(pieces.pop(0))
            while own[-1].end > ends[last]:
                last += 1
        words = []
        for p in own:
            seen = raw[p.start : p.end]
            if p.changed:
                words.append(p.shown[0].upper() + p.shown[1:] if seen[0].isupper() else p.shown)
            else:
                words.append(_BREAKS.sub(lambda m, p=p: "-" if "-" in p.shown and m[0] == MARK and not p.dropped else "", seen))
            if p.dropped:
                noise.add("line_hyphen")
        if len(own) == 1 and own[0].changed:
            noise.add("misread_chars")
        if last > k or len(own) > 1 or own[0].changed:
            parts[window[k].line][window[k].at] = window[k].before + " ".join(words) + window[last].after
            for t in window[k + 1 : last + 1]:
                line = parts[t.line]
                line[t.at] = ""
                if t.at and line[t.at - 1].isspace():
                    line[t.at - 1] = ""
        k = last + 1


#: A paragraph of fewer lines may be so small that it costs more.
SHORT = 4


def paragraphs(lines: list[str]) -> list[list[str]]:
    """Lines grouped into paragraphs: the grouping of least cost over all line ends."""
    lines = [x.strip() for x in lines]
    width = max((len(x) for x in lines), default=0)

    def end_cost(i: int) -> tuple[float, float]:
        """(cost of a break after line i, cost of none)."""
        x, y = lines[i], lines[i + 1]
        if not x or not y:
            return 0.0, 1.0
        closed = x[-1] in ".!?。！？:：" or bool(re.match(r"[#=|•*+>\\<]|\d+[.)] |- ", y)) or bool(re.match(r"[#=|•*+\\<]", x))
        short = len(x) < 0.7 * width
        return (0.5 if closed and short else 2.0 if closed else 4.0), (1.5 if closed and short else 0.5 if closed else 0.0)

    n = len(lines)
    ends = [end_cost(i) for i in range(n - 1)]
    # best[j]: the first j lines in whole paragraphs; long[j]: the same, but for a last paragraph of SHORT or more lines that may go on
    best, long = [0.0] + [math.inf] * n, [math.inf] * (n + 1)
    back, begun = [0] * (n + 1), [0] * (n + 1)

    def opened(i: int, j: int) -> float:
        """Cost of a paragraph of lines i to j - 1 and all before it."""
        return best[i] + (ends[i - 1][0] if i else 0.0) + sum(ends[k][1] for k in range(i, j - 1))

    for j in range(1, n + 1):
        if j >= SHORT:
            going, new = long[j - 1] + ends[j - 2][1], opened(j - SHORT, j)
            long[j], begun[j] = (going, begun[j - 1]) if going < new else (new, j - SHORT)
        best[j], back[j] = long[j], begun[j]
        for i in range(j - 1, max(-1, j - SHORT), -1):
            total = opened(i, j) + (0.3 if sum(map(len, lines[i:j])) < 20 else 0.0)
            if total <= best[j]:
                best[j], back[j] = total, i
    groups, j = [], n
    while j > 0:
        groups.append(lines[back[j] : j])
        j = back[j]
    return [[x for x in g if x] for g in reversed(groups) if any(g)]


def read_block(text: str | None, marks: Marks, vocabulary: Vocabulary, repair: bool = True) -> tuple[set[str], str | None]:
    """(noise, repaired text) of one block."""
    if not text or not text.strip():
        return set(), text
    noise: set[str] = set()
    if "\n" not in text:
        kept = [text]
    else:
        kinds = line_kinds(text, marks)
        noise = set().union(*(n for _, n in kinds))
        kept = []
        for line, kind in kinds:
            if kind:
                while kept and not kept[-1].strip():
                    kept.pop()
                kept.append("\x00")
            elif line.strip() or not kept or kept[-1] != "\x00":
                kept.append(line)
        kept = [x for x in kept if x != "\x00"]
    held: list[str] = []

    def hold(m: re.Match) -> str:
        held.append(m[0])
        return f"\n\ue000{len(held) - 1}\ue001\n" if "\n" in m[0] and _CODE.fullmatch(m[0]) else f"\ue000{len(held) - 1}\ue001"

    lines, found = read_words(_MASKED.sub(hold, "\n".join(kept)).split("\n"), vocabulary)
    noise |= found
    if not repair:
        return noise, None
    parts: list[str] = []
    prose: list[str] = []
    for line in [*lines, None]:
        shown = _HELD.fullmatch(line.strip()) if line is not None else None
        if line is None or shown and "\n" in held[int(shown[1])] and _CODE.fullmatch(held[int(shown[1])]):
            parts += [" ".join(g) for g in paragraphs(prose)]
            prose = []
            if shown:
                parts.append(held[int(shown[1])])
        else:
            prose.append(_HELD.sub(lambda m: held[int(m[1])], line))
    return noise, "\n\n".join(parts)


def read_blocks(blocks: DataFrame, papers: DataFrame, repair: bool = True) -> DataFrame:
    """(block_id, noise, text): the noise of each text block and, if asked for, its repaired text."""
    held = blocks.sparkSession.sparkContext.broadcast(load_vocabulary(word_counts(blocks)))
    texts = blocks.where("modality = 'text' and content is not null").select("block_id", F.col("address.paper_id").alias("paper_id"), "content")
    known = papers.select("paper_id", "title", "venue", "authors").dropDuplicates(["paper_id"])
    many = texts.where(F.col("content").contains("\n")).join(known, "paper_id", "left")
    one = texts.where(~F.col("content").contains("\n")).select("paper_id", "block_id", "content", *(F.lit(None).cast("string").alias(c) for c in ("title", "venue", "authors")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocabulary = None
        for b in batches:
            vocabulary = vocabulary or Vocabulary(held.value)
            rows = []
            for block, text, *about in zip(b["block_id"], b["content"], b["title"], b["venue"], b["authors"]):
                noise, repaired = read_block(text, Marks(*about), vocabulary, repair)
                rows.append((block, "|".join(sorted(noise)), repaired))
            yield pd.DataFrame(rows, columns=["block_id", "noise", "text"])

    columns = ["block_id", "content", "title", "venue", "authors"]
    return many.select(columns).unionByName(one.select(columns)).mapInPandas(run, "block_id string, noise string, text string")


def found_noise(blocks: DataFrame, papers: DataFrame) -> DataFrame:
    rows = read_blocks(blocks, papers, repair=False).where("noise != ''")
    return rows.select("block_id", F.explode(F.split("noise", r"\|")).alias("noise")).distinct()


def repaired(blocks: DataFrame, papers: DataFrame) -> DataFrame:
    """(block_id, text) of every text block as continuous paragraphs."""
    return read_blocks(blocks, papers).select("block_id", "text").dropDuplicates(["block_id"])
