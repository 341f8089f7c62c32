"""Keyword-stuffed pages, bare link lists and product tags, by block-wise compression and punctuation (problem 9)."""

from __future__ import annotations

import html
import re
import unicodedata
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A page is a case if more than this share of its letters stands in blocks of stuffed words, bare links or tags.
SHARE = 0.5
#: Block length, in characters of normalised text, at which redundancy is measured.
BLOCK = 1200
#: Text shorter than this in all is too little for compression to tell anything.
LEAST_TEXT = 120
#: A block is redundant if it compresses to less than this share of what prose of its length and language does.
REDUNDANT = 0.92
#: A block of any text, sentences included, is stuffed if it compresses to less than this share, and its different sentences to less than DISTINCT.
EXTREME, DISTINCT = 0.68, 0.85
#: A segment with this share of function words or more is running text (prose or lyrics), whatever its punctuation.
FUNCTION_SHARE = 0.2

#: A line of verse has so many words at most.
VERSE_WORDS = 12

# Zlib ratio of ordinary prose as a + b * length ** -0.5 (bytes), by language; measured on running text.
PROSE = {"en": (0.36, 6.0), "de": (0.36, 6.0), "fr": (0.34, 6.0), "es": (0.34, 6.0), "zh": (0.40, 6.0), "ja": (0.33, 6.0)}

# Function words of the languages in the data.
FUNCTION = frozenset(
    "the a an and or but if then than that this these those is are was were be been it its it's i you he she we they my your his her our their me him us them to of in on at by for from with as into after before "
    "not no nor so do does did has have had can could would should will there here what which who whose when where while because only just more most some any each "
    "der die das den dem des ein eine einen einem einer und oder aber wenn dass ist sind war waren nicht nur mit von zu zum zur im in am auf aus bei nach vor für als wie es sie er wir ich wer was "
    "le la les un une des du de et ou mais si que qui est sont était ne pas plus dans sur sous par pour avec au aux ce cette il elle nous vous ils on se sa son ses en "
    "el los las una unos unas y o pero si no es son fue con sin por para en del al que se su sus lo más entre hay".split()
)

_URL = r"(?:https?://|www\.)\S+|\b[\w-]+(?:\.[\w-]+)*\.(?:[a-z]{2,10})/\S+"
_LINK = re.compile(rf"<a\s[^>]*>|</a>|\[/?url[^\]]*\]|\]\((?:{_URL})\)?|{_URL}", re.I)
_HIDDEN = re.compile("[​-‏⁠﻿­]")
_LEET = str.maketrans("013457@$", "oieastas")
_CJK = re.compile("[぀-ヿ㐀-鿿]")
_END = re.compile(r"(?<=[.!?…])[\"'»”)]*\s+|(?<=[。！？])")
_TOKENS = re.compile(r"^[A-Z]{2,}(?:_[A-Z0-9]+)*(?:\s+[A-Z]{2,}(?:_[A-Z0-9]+)*)*\s*$")
_CHORD = r"[A-G](?:[#b♯♭])?(?:m|maj|min|dim|aug|sus)?\d{0,2}(?:sus\d|add\d)?(?:/[A-G][#b♯♭]?)?"
_CHORDS = re.compile(rf"^[\s|:.\-]*{_CHORD}(?:[\s|:.\-]+{_CHORD})*[\s|:.\-]*$")
_LABEL = re.compile(r"^\[[^\]]{1,24}\]$|^#{1,6}\s|^==+\s|^v?\d+(?:\.\d+)+\b")
_NUMBERS = re.compile(r"^[\w .%/-]*(?:[,;\t|][\w .%/-]*){2,}$")
_TRACK = re.compile(r"^\s*\d{1,3}[.)]\s.*\d{1,2}:\d{2}\s*$")
_TAG = re.compile(r"#[^\W\d_][\w-]*")
_PRICE = re.compile(r"[$€£¥]\s?\d[\d.,]*|\d[\d.,]*\s?[$€£¥]|-\d+\s?%|\bSKU\b\s*[\w-]*", re.I)
_RUN = re.compile(r"(.)\1{3,}", re.S)
_CHANGE = re.compile(r"^\s*[-*+•]\s+\w+(?:\s+\w+){1,6}$")


def _repaired(text: str) -> str:
    """UTF-8 that was read as Latin-1 or Windows-1252, read anew; other text as it is."""
    if re.search("[\u00c2-\u00ef][\u0080-\u00bf\u2018-\u203a\u20ac]", text):
        for encoding in ("latin-1", "cp1252"):
            try:
                return text.encode(encoding).decode("utf-8")
            except UnicodeError:
                pass
    return text


def unveil(text: str) -> str:
    """Broken encodings, entities, invisible characters, full-width forms and digits that stand for letters inside words are undone."""
    text = _HIDDEN.sub("", unicodedata.normalize("NFKC", html.unescape(_repaired(text))))
    return re.sub(r"\r\n?| | |\x85", "\n", text)


def _word(w: str) -> str:
    return w.translate(_LEET) if re.search(r"[^\W\d_]", w) and re.search(r"[\d@$]", w) else w


def _size(text: str) -> int:
    return sum(c.isalnum() for c in text)


def _running(words: list[str]) -> float:
    return sum(w in FUNCTION for w in words) / max(1, len(words))


def segments(text: str) -> list[tuple[str, str]]:
    """(kind, text) of the pieces of a text: 'prose', 'verse' (unpunctuated lines that run, as in lyrics), 'music' (structured content), 'link', 'tag' or 'loose' (unpunctuated words)."""
    out: list[tuple[str, str]] = []
    after_version = False
    for line in text.split("\n"):
        line = line.strip()
        if not line:
            continue
        if re.match(r"^(?:[#=*]+\s*)?v?\d+(?:\.\d+)+\b.{0,20}$", line):
            after_version = True
            out.append(("music", line))
            continue
        if after_version and _CHANGE.match(line):
            out.append(("music", line))
            continue
        after_version = False
        if _TOKENS.match(line) and "_" in line or _CHORDS.match(line) and re.search(r"\s", line) or _TRACK.match(line) or re.match(r"^\[[^\]]{1,24}\]$", line):
            out.append(("music", line))
            continue
        if _NUMBERS.match(line) and sum(c.isdigit() for c in line) >= 0.4 * max(1, _size(line)) and not _PRICE.search(line):
            out.append(("music", line))
            continue
        bare = _LINK.sub(" ", line)
        links = _LINK.findall(line)
        if links:
            words = re.findall(r"[^\W\d_]+(?:'[^\W\d_]+)?", bare.lower())
            told = len(words) >= 5 and _running(words) >= FUNCTION_SHARE or len(_CJK.findall(bare)) >= 12 and re.search("[。！？]", bare)
            out.append(("prose" if told else "link", line))
            continue
        if _PRICE.search(line) and len(_PRICE.findall(line)) * 12 >= len(line) * 0.25 or sum(map(len, _TAG.findall(line))) >= 0.5 * len(line.replace(" ", "")) and not re.match(r"^#{1,6}\s", line):
            out.append(("tag", line))
            continue
        if re.match(r"^(?:#{1,6}\s|==+\s)", line):
            out.append(("prose", line))
            continue
        sentences = [x for x in _END.split(line) if x and x.strip()]
        for part in sentences:
            words = [_word(w) for w in re.findall(r"[\w@$]+(?:'\w+)?", part.lower())]
            cjk = len(_CJK.findall(part))
            ended = re.search(r"[.!?…。！？][\"'»”)]*\s*$", part) is not None
            if ended and (len(words) >= 4 and not cjk or cjk >= 6) or not cjk and len(words) >= 4 and _running(words) >= FUNCTION_SHARE or cjk and re.search("[。！？]", part):
                out.append(("verse" if len(sentences) == 1 and not ended and not cjk and len(words) <= VERSE_WORDS else "prose", part))
            else:
                out.append(("loose", " ".join(words) if not cjk else part))
    return out


def _ratio(block: str) -> float:
    raw = block.encode()
    return (len(zlib.compress(raw, 6)) - 8) / max(1, len(raw))


def redundancy(block: str, lang: str) -> float:
    """Compression ratio of a block as a share of what prose of its length and language compresses to; links, prices and codes count as one sign each."""
    plain = _PRICE.sub("¤", _LINK.sub("§", block)).lower()
    a, b = PROSE.get(lang, PROSE["en"])
    n = max(1, len(plain.encode()))
    return _ratio(plain) / min(1.2, a + b * n**-0.5)


def language(lang: str | None, text: str) -> str:
    """The language a block is measured by: by script where that settles it, else by the label."""
    cjk = len(_CJK.findall(text))
    if cjk > 40 or cjk * 5 > len(text):
        return "ja" if re.search("[぀-ヿ]", text) else "zh"
    return (lang or "en")[:2].lower()


def _blocks(parts: list[tuple[int, str]]) -> list[list[tuple[int, str]]]:
    """(index, text) of segments -> runs of BLOCK characters or more; a short rest joins the block before, so that no block is too short to measure."""
    blocks: list[list[tuple[int, str]]] = []
    now: list[tuple[int, str]] = []
    for part in parts:
        now.append(part)
        if sum(len(t) + 1 for _, t in now) >= BLOCK:
            blocks.append(now)
            now = []
    if now:
        if blocks and sum(len(t) + 1 for _, t in now) < BLOCK // 3:
            blocks[-1] += now
        else:
            blocks.append(now)
    return blocks


def stuffed(block: list[str], lang: str | None) -> bool:
    """Whether a block is extremely redundant, punctuated or not; a passage of prose that is only repeated isn't, since its different sentences are ordinary."""
    whole = _RUN.sub(r"\1", "\n".join(block))
    by = language(lang, whole)
    if len(whole) < LEAST_TEXT or redundancy(whole, by) >= EXTREME:
        return False
    return redundancy(_RUN.sub(r"\1", "\n".join(dict.fromkeys(t.lower() for t in block))), by) < DISTINCT


def spam_share(text: str, lang: str | None) -> float:
    """Share of a text's letters that stands in redundant blocks.

    Redundancy is measured twice: over everything but verse and structured content, where only extreme redundancy
    counts, whatever the punctuation; and over loose words, links and tags, where missing sentences confirm a lesser one.
    """
    parts = [(kind, t[i : i + BLOCK]) for kind, t in segments(unveil(text)) for i in range(0, len(t), BLOCK)]
    total = sum(_size(t) for _, t in parts)
    if not total:
        return 0.0
    bad: set[int] = set()
    for block in _blocks([(i, t) for i, (kind, t) in enumerate(parts) if kind not in ("music", "verse")]):
        if stuffed([t for _, t in block], lang):
            bad.update(i for i, _ in block)
    for block in _blocks([(i, t) for i, (kind, t) in enumerate(parts) if kind in ("link", "tag", "loose")]):
        plain = "".join(t + "\n" for _, t in block)
        if len(plain) >= LEAST_TEXT and redundancy(plain, language(lang, plain)) < REDUNDANT or len(_LINK.findall(plain)) * 40 >= len(plain) * 0.3:
            bad.update(i for i, _ in block)
    return sum(_size(parts[i][1]) for i in bad) / total


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        shares = [spam_share(t, g) if t else 0.0 for t, g in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shares, pa.float64())], names=["doc_id", "share"])


def spam_shares(docs: DataFrame) -> DataFrame:
    """`doc_id`, `share`: one row per document; null, empty and blank texts have share 0."""
    return docs.select("doc_id", "text", "lang").mapInArrow(_judge, "doc_id long, share double")


def spam_pages(docs: DataFrame) -> DataFrame:
    """`doc_id`: documents of which more than SHARE is stuffed words, bare links or product tags."""
    return spam_shares(docs).where(F.col("share") > SHARE).select("doc_id")
