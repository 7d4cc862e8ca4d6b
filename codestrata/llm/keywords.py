"""Keyword-stuffed and link-list pages, found by how unlike prose their word-class sequences are.

Each token becomes one of 16 classes: function words by their part of speech, other words by their shape, links,
tags, code, numbers and signs. Class sequences of N tokens are counted over all documents' prose (units that end
as sentences and hold function words), which gives a model of at most 16**N entries whatever the corpus. A unit of
text whose perplexity lies outside the range that prose units keep to, above or below, is abnormal, and a page
with more words and links in abnormal units than in others is flagged.

The function words known are those of four languages. Sentences of another language lack them and are improbable
to the model, so that their shape excuses them: a capital or a script without capitals, few commas, words that do
not repeat, an end. It excuses nothing on a page whose content words repeat far more than a text's of its length
do; there function words strewn among the keywords do not excuse them either.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.session import Scratch, table

N = 5
BREAK, DET, PREP, CONJ, PRON, AUX, ADV, LOWER, UPPER, MIXED, NUMBER, LINK, TAG, CODE, STOP, SIGN = range(16)
A = 16

# Function words of English, German, Spanish and French by part of speech.
_WORDS = {
    DET: "a an the this that these those each every some any no all both either neither my your his her its our their der die das den dem des ein eine einen einem einer eines kein keine dieser diese dieses jede jeder "
    "el la los las un una unos unas este esta estos estas cada su sus ningún le les une des du ce cette ces chaque sa son leur aucun aucune l",
    PREP: "of in on at by for from with without into onto over under between among through during against about after before since until within per via to as than upon toward towards in auf an bei mit von vom zu zum zur für aus nach "
    "über unter zwischen durch gegen ohne um vor seit de del en con sin por para sobre entre hasta desde hacia según à au aux dans sur sous avec sans pour par chez vers d",
    CONJ: "and or but nor so yet if because while when whenever though although unless once whether where whereas rather und oder aber denn weil wenn während obwohl dass ob sondern sobald bevor y e o u pero si porque cuando mientras aunque que "
    "sino et ou mais car donc ni lorsque quand puisque tandis parce",
    PRON: "i you he she it we they me him us them who whom whose which what whatever nobody nothing somebody something everyone one ich du er sie es wir ihr man sich wer was nichts niemand yo tú él ella nosotros ellos ellas se lo quien cual nada nadie "
    "je tu il elle nous vous ils elles on qui dont quoi rien se s y",
    AUX: "is are was were be been being am do does did have has had can could will would shall should may might must not ist sind war waren sein hat haben hatte wird werden wurde kann können muss müssen soll nicht es son era fue ser está están ha han puede "
    "debe no est sont était être a ont peut doit ne pas",
    ADV: "then still only again always never often usually first also too very just there here now please later soon danach immer nie oft wieder noch schon auch nur hier dort jetzt kaum erneut selten später luego después siempre nunca apenas hoy aún ya "
    "también muy ensuite toujours jamais souvent encore parfois bientôt déjà aussi très",
}
_CLASS = {}
for _c, _w in _WORDS.items():
    for _x in _w.split():
        _CLASS.setdefault(_x, _c)

# Code in back quotes, links, tags, words, numbers, words with digits, sentence ends, and signs; a stop within a word is none of them.
_TOKEN = re.compile(
    r"`[^`\n]+`|(?:https?|ftp)://[^\s<>\"')\]]+|www\.[^\s<>\"')\]]+|[\w.+-]+@[\w-]+\.[\w.]+|[#@][^\W\d_][\w-]*|[^\W\d_]+(?:['’-][^\W\d_]+)*(?![\w])|\d+(?:[.,:]\d+)*(?![\w])|\w+|[.!?]+(?=[\s\"')\]]|$)|[。！？।؟۔]+|[^\w\s.!?]"
)
_OPEN_TAG = re.compile(r"<a\s[^<>]*?href\s*=\s*[\"']?([^\"'\s>]+)[^<>]*>", re.I)
_HTML = re.compile(r"</?[A-Za-z][^<>]*>")
_MARK = re.compile(r"^[ \t]*(?:[-*+>|]+|#{1,6}(?=\s)|\d+[.)](?=\s)|\[[^\]\n]{0,20}\](?!\())[ \t]*")
# A link with its label or its brackets, as it stands before or behind a sentence.
_ATTACHED = re.compile(r"\(?\[[^\[\]\n]*\]\(\s*(?:https?|ftp)://[^\s()]*\s*\)\)?:?|\((?:see|siehe|ver|voir|cf\.?)?\s*(?:https?|ftp)://[^\s()]*\s*\)|(?:https?|ftp)://[^\s<>\"')\]]+", re.I)
FUNCTION_SHARE = 0.15
# Lines that are neither prose nor keywords: calls and rules.
_NEUTRAL = re.compile(r"^[ \t]*(?:[-=*_]{3,}[ \t]*$|[\w./-]+\(.*\);?[ \t]*$)")
_INDENTED = re.compile(r"^(?: {4}|\t)")
_ROW = re.compile(r"^[ \t]*\|.*\|[ \t]*$")
_BAR = re.compile(r"[ \t]*\|[ \t|:-]*")
_LINKS = re.compile(r"\[[^\[\]\n]*\]\([^()\s]*\)|(?:https?|ftp)://[^\s<>\"')\]]+|www\.[^\s<>\"')\]]+|[\w.+-]+@[\w-]+\.[\w.]+")
# Signs of code in a line without its links.
_CODE_LINE = re.compile(
    r"[;{}][ \t]*$|^[ \t]*[\])}]|[A-Za-z_]\w*\(|(?:^|\s)(?:=|:=|=>|->|==|!=|<=|>=|&&|[-+*]=|<-)(?:\s|$)|^[ \t]*(?:\$|>>>) |^[ \t]*(?:def|func|fn|elif|#include)\b|^[ \t]*(?:import|package|return|from)[ \t]+[\w.*\"']+$|"
    r"\w::\w|[A-Za-z]\w*\.[A-Za-z]\w*\.\w+|\s--\w|\w/\w+/|(?<![.\w])\w+/[\w.-]*\.\w{1,4}\b|(?<![#@\w])[A-Za-z]+_[A-Za-z]|^[ \t]*[\w.-]+[ \t]*[:=][ \t]*\S+$|^[ \t]*\w+:[ \t]*$"
)
UNIT, LEAST_UNIT = 40, 6
MIN_UNIT = 4
MIN_TRAIN_WORDS, MIN_TRAIN_FUNCTION = 5, 2
HIGH, LOW = 1.25, 0.7  # deviations of the prose's bits per token by which a unit's mean may lie above and below theirs
BATCH_ROWS = 1000


class _Classes(dict):
    """The class of each token seen, worked out once; forgotten when there are very many."""

    def __missing__(self, t: str) -> int:
        if len(self) > 500_000:
            self.clear()
        c = t[0]
        if c == "`" and len(t) > 2:
            k = CODE
        elif c in ".!?。！？।؟۔":
            k = STOP
        elif c in "#@" and len(t) > 1:
            k = TAG
        elif "://" in t or t.startswith("www.") or "@" in t and len(t) > 3:
            k = LINK
        elif c.isdigit() and not any(x.isalpha() or x == "_" for x in t):
            k = NUMBER
        elif not (c.isalnum() or c == "_"):
            k = SIGN
        elif "_" in t:
            k = CODE
        elif any(x.isdigit() for x in t):
            k = MIXED
        else:
            w = t.lower()
            k = _CLASS.get(w)
            if k is None and ("'" in w or "’" in w):
                k = _CLASS.get(re.split("['’]", w)[0])
            if k is None:
                k = UPPER if c.isupper() else LOWER
        self[t] = k
        return k


_class_of = _Classes()


class _Content(dict):
    """Each token in lower case if it is a content word, else ""; as `_Classes`."""

    def __missing__(self, t: str) -> str:
        if len(self) > 500_000:
            self.clear()
        self[t] = w = t.lower() if _class_of[t] in _CONTENT_CLASSES else ""
        return w


_content_of = _Content()


# A text of n content words has some REPEAT_SCALE * n ** REPEAT_POWER different ones; with less than REPEAT_SHARE of that it repeats itself.
REPEAT_SCALE, REPEAT_POWER, REPEAT_SHARE, REPEAT_WORDS = 3.0, 0.72, 0.4, 30


def _tokens(line: str) -> tuple[list[int], list[str]]:
    found = _TOKEN.findall(line)
    return [_class_of[t] for t in found], found


def _is_sentence(seq: list[int], tokens: list[str]) -> bool:
    """Whether a piece has the shape of a sentence, in whatever language."""
    if seq[-1] != STOP or LINK in seq or TAG in seq:
        return False
    if len(_FUNCTION_CLASSES.intersection(seq)) > 2:
        return True  # its function words are known
    words = [t for c, t in zip(seq, tokens, strict=True) if c in _WORD_CLASSES]
    if not words or words[0][0].islower():
        return False
    if sum(map(len, words)) >= 5 and all(not x[0].islower() and not x[0].isupper() for x in words):
        return True  # a script without capitals, which may not part words either
    few = len(words) >= MIN_TRAIN_WORDS and sum(x[0].isupper() for x in words[1:]) * 2 <= len(words)
    return few and tokens.count(",") * 3 <= len(words) and len({x.lower() for x in words}) * 4 >= len(words) * 3


def _classes(line: str) -> list[int]:
    return [_class_of[t] for t in _TOKEN.findall(line)]


def _is_code(line: str) -> bool:
    """Whether a line of a table or of an indented or fenced block looks like code or numbers."""
    bare = _LINKS.sub(" ", line)
    if _CODE_LINE.search(bare):
        return True
    seq = _classes(bare)
    numbers = sum(c in (NUMBER, CODE) for c in seq)
    return numbers > 0 and numbers >= sum(c in _WORD_CLASSES for c in seq)


def _lines(text: str) -> Iterator[str]:
    """The lines to classify, without heading signs and cell bars; "" for those that are not.

    Of tables and of indented or fenced blocks all lines are left out if half of them look like code or numbers, else those that do.
    """
    block: list[str] = []
    kind, fenced = "", False

    def over() -> Iterator[str]:
        code = [_is_code(x) for x in block]
        all_code = 2 * sum(code) >= len(code)
        yield from ("" if all_code or c else x for x, c in zip(block, code, strict=True))
        block.clear()

    for line in text.split("\n"):
        fence = line.lstrip().startswith("```")
        if fence:
            fenced = not fenced
        row = _ROW.match(line) is not None
        now = "" if fence else "fence" if fenced else "row" if row else "indent" if _INDENTED.match(line) else ""
        if not fence and not line.strip():
            if not fenced:
                yield from over()
            kind = now
            yield ""
            continue
        if now != kind or fence:
            yield from over()
            kind = now
        if row and not fence:
            line = _BAR.sub("  ", line)
        if fence or not line.strip() or _NEUTRAL.match(line):
            yield ""
        elif now:
            block.append(line)
        else:
            yield line
    yield from over()


def classify(text: str) -> tuple[list[list[list[int]]], list[bool], tuple[int, int]]:
    """Units of the text as pieces (sentences, or lines without one) of class sequences; whether each has the shape of sentences; and the content words, all and different ones.

    Code, numbers and rules are left out. A line that goes on in lower case is joined to the one before unless that
    ended a sentence. A link that is attached to a sentence is left out; a line that has links but no sentence keeps
    them. A piece of UNIT tokens is cut; neighbouring pieces of less than LEAST_UNIT tokens are put together.
    """
    t = _OPEN_TAG.sub(r" \1 ", text) if "<" in text else text
    t = _HTML.sub(" ", t) if "<" in t else t
    lines: list[tuple[list[int], list[str]]] = []
    after = False  # whether the next line may go on with the last one
    for line in _lines(t):
        if not line:
            after = False
            continue
        line = _MARK.sub("", line)
        seq, tokens = _tokens(line)
        if LINK in seq:
            bare, rest = _tokens(_ATTACHED.sub(" ", line))
            words = [c for c in bare if c in _WORD_CLASSES]
            if len(words) >= MIN_TRAIN_WORDS and sum(c in _FUNCTION_CLASSES for c in words) >= max(MIN_TRAIN_FUNCTION, FUNCTION_SHARE * len(words)):
                seq, tokens = [c for c in bare if c != LINK], [x for c, x in zip(bare, rest, strict=True) if c != LINK]
        if after and line.lstrip()[:1].islower() and seq:
            lines[-1][0].extend(seq)
            lines[-1][1].extend(tokens)
        elif seq:
            lines.append((seq, tokens))
        after = bool(seq) and seq[-1] != STOP
    units: list[list[list[int]]] = []
    shapes: list[bool] = []
    unit: list[list[int]] = []
    shaped, held, content, different = True, 0, 0, set()
    for seq, tokens in lines:
        own = [w for w in map(_content_of.__getitem__, tokens) if w]
        content += len(own)
        different.update(own)
        at = 0
        while at < len(seq):
            end = at + UNIT
            for k in range(at, min(end, len(seq))):
                if seq[k] == STOP:
                    end = k + 1
                    break
            piece, shape = seq[at:end], _is_sentence(seq[at:end], tokens[at:end])
            at = end
            if unit and len(piece) >= LEAST_UNIT:
                units.append(unit)
                shapes.append(shaped)
                unit, shaped, held = [], True, 0
            unit.append(piece)
            shaped = shaped and shape
            held += len(piece)
            if held >= LEAST_UNIT:
                units.append(unit)
                shapes.append(shaped)
                unit, shaped, held = [], True, 0
    if unit:
        units.append(unit)
        shapes.append(shaped)
    return units, shapes, (content, len(different))


_WORD_CLASSES = frozenset({DET, PREP, CONJ, PRON, AUX, ADV, LOWER, UPPER, MIXED, TAG})
_FUNCTION_CLASSES = frozenset({DET, PREP, CONJ, PRON, AUX, ADV})
_CONTENT_CLASSES = frozenset({LOWER, UPPER, MIXED, TAG})
# What a token adds to a page's words; a link stands for the words of its host and path.
_WEIGHT = np.zeros(A, dtype=np.int64)
_FUNCTION = np.zeros(A, dtype=bool)
_FUNCTION[[DET, PREP, CONJ, PRON, AUX, ADV]] = True
_WEIGHT[[DET, PREP, CONJ, PRON, AUX, ADV, LOWER, UPPER, MIXED, TAG]] = 1
_WEIGHT[LINK] = 3


def _codes(pieces: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """The N-gram number of each token, every piece beginning after N - 1 breaks, and its piece."""
    flat = np.array([x for s in pieces for x in [BREAK] * (N - 1) + s], dtype=np.int64)
    sizes = np.array([len(s) + N - 1 for s in pieces], dtype=np.int64)
    piece = np.repeat(np.arange(len(pieces)), sizes)
    code = np.zeros(len(flat), dtype=np.int64)
    for k in range(N):
        shifted = np.concatenate([np.zeros(N - 1 - k, dtype=np.int64), flat])[: len(flat)]
        code = code * A + shifted
    real = np.arange(len(flat)) - (np.cumsum(sizes) - sizes)[piece] >= N - 1
    return code[real], piece[real]


def _repeats(content: int, different: int) -> bool:
    return content >= REPEAT_WORDS and different < REPEAT_SHARE * REPEAT_SCALE * content**REPEAT_POWER


def _is_prose(s: list[int]) -> bool:
    """A sentence to learn from."""
    words = sum(c in _WORD_CLASSES for c in s)
    function = sum(c in _FUNCTION_CLASSES for c in s)
    return s[-1] == STOP and words >= MIN_TRAIN_WORDS and function >= max(MIN_TRAIN_FUNCTION, FUNCTION_SHARE * words) and LINK not in s and TAG not in s


PIECE, UNIT_END, SENTENCES_END = 255, 254, 253
_HEAD = struct.Struct("<QQ")


def encode(text: str) -> bytes:
    """The counts of the text's content words, then its units as a byte for each token, PIECE after each piece and UNIT_END, or SENTENCES_END, after each unit."""
    units, shapes, counts = classify(text)
    out = bytearray(_HEAD.pack(*counts))
    for u, shape in zip(units, shapes, strict=True):
        for piece in u:
            out += bytes(piece)
            out.append(PIECE)
        out.append(SENTENCES_END if shape else UNIT_END)
    return bytes(out)


def decode(code: bytes) -> tuple[list[list[list[int]]], list[bool], tuple[int, int]]:
    """What `classify` gave."""
    body = code[_HEAD.size :]
    ends = [c == SENTENCES_END for c in body if c in (UNIT_END, SENTENCES_END)]
    units = body.replace(bytes([SENTENCES_END]), bytes([UNIT_END])).split(bytes([UNIT_END]))[:-1]
    return [[list(p) for p in u.split(bytes([PIECE]))[:-1]] for u in units], ends, _HEAD.unpack_from(code)


def encoded(docs: DataFrame) -> DataFrame:
    """(doc_id, code) of documents (doc_id, text), each read and classified once."""

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "code": [encode(t) for t in pdf["text"]]})

    return docs.mapInPandas(run, "doc_id long, code binary")


def prose_counts(codes: DataFrame) -> DataFrame:
    """(code, n): how often each sequence of N classes occurs in the prose of all texts but those that repeat themselves. At most 16**N rows."""

    def run(batches):
        for pdf in batches:
            for at in range(0, len(pdf), BATCH_ROWS):
                pages = [decode(c) for c in pdf["code"].iloc[at : at + BATCH_ROWS]]
                seqs = [s for units, _, counts in pages if not _repeats(*counts) for u in units for s in u if _is_prose(s)]
                code, _ = _codes(seqs)
                found, n = np.unique(code, return_counts=True)
                yield pd.DataFrame({"code": found, "n": n.astype("int64")})

    return codes.select("code").mapInPandas(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def model(counts: pd.DataFrame) -> tuple[np.ndarray, float, float]:
    """Bits of each N-gram's last class given those before, and their mean and deviation over the prose.

    Orders are interpolated by the Witten-Bell rule, from the uniform distribution upwards. Without prose every
    class is equally likely and nothing is abnormal.
    """
    full = np.zeros(A**N)
    full[counts["code"].to_numpy(dtype=np.int64)] = counts["n"].to_numpy()
    p = np.full((1, A), 1.0 / A)
    for k in range(1, N + 1):
        c = full.reshape(A ** (N - k), A ** (k - 1), A).sum(axis=0)
        total, kinds = c.sum(axis=1, keepdims=True), (c > 0).sum(axis=1, keepdims=True)
        lower = np.tile(p, (max(1, len(c) // len(p)), 1)) if k > 1 else p
        p = (c + kinds * lower) / np.maximum(total + kinds, 1)
        p = np.where(total > 0, p, lower)
    bits = -np.log2(p).reshape(-1)
    total = full.sum()
    mean = float((bits * full).sum() / total) if total else np.log2(A)
    spread = float(np.sqrt((np.square(bits - mean) * full).sum() / total)) if total else 0.0
    return bits.astype(np.float32), mean, spread


def shares(codes: list[bytes], bits: np.ndarray, mean: float, spread: float) -> list[tuple[int, int]]:
    """Per encoded text: words and links in abnormal units, and in all units that count."""
    pieces, unit, owner, shaped, repeats = [], [], [], [], []
    for i, c in enumerate(codes):
        units, shapes, (content, different) = decode(c)
        shaped += shapes
        repeats += [_repeats(content, different)] * len(units)
        for u in units:
            pieces += u
            unit += [len(owner)] * len(u)
            owner.append(i)
    out = np.zeros((len(codes), 2), dtype=np.int64)
    if not pieces or not spread:
        return [tuple(map(int, x)) for x in out]
    code, piece = _codes(pieces)
    of, n = np.array(unit)[piece], len(owner)
    size = np.bincount(of, minlength=n)
    entropy = np.bincount(of, weights=bits[code], minlength=n) / np.maximum(size, 1)
    high, low = entropy > mean + HIGH * spread, entropy < mean - LOW * spread
    words = np.bincount(of, weights=_WEIGHT[code % A], minlength=n).astype(np.int64)
    lacking = np.bincount(of, weights=_FUNCTION[code % A], minlength=n) < FUNCTION_SHARE * words
    repeated, sentences = np.array(repeats), np.array(shaped)
    # Odd sentences are sentences still: shouted, cut off or in a list, they keep their function words, and those of other languages their shape.
    odd = (size >= MIN_UNIT) & np.where(repeated, high | (low & lacking), (high | low) & lacking & ~sentences)
    np.add.at(out, (np.array(owner), 0), words * odd)
    np.add.at(out, (np.array(owner), 1), words)
    return [tuple(map(int, x)) for x in out]


def page_shares(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, abnormal, words) of each document (doc_id, text) that is not NULL or blank; other columns are ignored.

    The model is counted over all documents. Texts are classified once, into a table of a byte a token. A page without words has
    zeros. Repeated rows stay repeated; copies get the same figures; texts of any length are taken whole.
    """
    docs = docs.select("doc_id", "text").where(F.col("text").rlike(r"\S"))
    codes = Scratch(spark, "pages").write(encoded(docs), "codes")
    counts = prose_counts(codes).toPandas()  # at most 16**N rows
    fitted = spark.sparkContext.broadcast(model(counts))  # 16**N floats

    def run(batches):
        for pdf in batches:
            for at in range(0, len(pdf), BATCH_ROWS):
                part = pdf.iloc[at : at + BATCH_ROWS]
                both = shares(part["code"].tolist(), *fitted.value)
                yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy(), "abnormal": [a for a, _ in both], "words": [b for _, b in both]})

    return codes.mapInPandas(run, "doc_id long, abnormal long, words long")


def p10_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_shares(spark, table(spark, sf_dir, "documents"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p10_shares(spark, sf_dir).where("abnormal * 2 > words").select("doc_id").distinct()


QUERIES = {"p10_found": p10_found, "p10_shares": p10_shares}
SQL: dict = {}
