"""Variant spellings of typed names: trie join with Levenshtein automata, token-order check, linking (problem 3)."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from melisma.operators.graph import components
from melisma.tables import materialise

#: Greatest edit distance of two keys of at least LONG letters; shorter keys get 1.
EDITS, LONG = 2, 8
#: An index trie holds at most about this many keys, and sees at most about this many probes; a larger shard is split both ways.
TRIE_KEYS, TRIE_PROBES = 20_000, 100_000
#: Up to so many keys of a shard are each compared with a probe by their letters before its trie is searched.
FEW_KEYS = 512

# Words that name a kind of ensemble and the short forms people type for them.
ENSEMBLE = {
    "orchestra": ("orch",), "band": ("bd",), "string": ("str", "strings"), "quartet": ("qt", "qrt", "quart"), "quintet": ("qnt", "qt5"),
    "choir": ("chr",), "community": ("comm",), "chamber": ("ch", "chmb"), "jazz": ("jz",), "brass": ("brs", "br"), "wind": ("wd",),
    "trio": ("tr",), "big": ("bg",), "ensemble": ("ens",), "youth": ("yth",), "folk": ("fk",), "philharmonic": ("phil", "philh"),
    "ceilidh": ("cl", "ceil"), "symphony": ("sym", "symph"), "chorus": ("chor",), "consort": (), "sinfonia": (), "collective": (), "group": ("grp",), "singers": (), "players": (),
}
#: Of these, the words that only come before another one.
ADJECTIVES = frozenset("string community chamber jazz brass wind big youth folk ceilidh".split())
# Common short forms of given names.
NICKNAMES = {
    "alexander": "alex alec sandy sasha xander al", "anthony": "tony", "andrew": "andy drew", "benjamin": "ben benny", "casimir": "kazik cas caz", "catherine": "cathy kate", "charles": "charlie chuck",
    "christopher": "chris kit topher", "daniel": "dan danny", "david": "dave", "delphine": "del delphie", "dorothy": "dot dottie dolly dory", "edward": "ed eddie ned ted teddy", "elizabeth": "liz lizzie beth betty eliza libby bess lisa",
    "francisco": "paco pancho fran cisco", "frederick": "fred freddie freddy fritz", "gabriella": "gabby gabi ella gaby", "giuseppe": "beppe peppe pino", "heinrich": "heinz heiner henry", "henry": "hank harry",
    "hester": "hettie hetty", "james": "jim jimmy jamie", "johannes": "hans hannes jo", "john": "jack johnny jon", "joseph": "joe joey jos", "katherine": "kate kathy katie kat kitty", "leopold": "leo poldi", "lucian": "luc lucky",
    "margaret": "maggie meg peggy greta marge madge", "michael": "mike mick mikey micky", "natalia": "natasha nat talia", "nicholas": "nick", "patricia": "pat patty", "pascal": "pasco", "peter": "pete", "quentin": "quent quin", "richard": "rick dick rich richie ricky",
    "robert": "bob bobby rob robbie bert", "rosalind": "rosa roz ros rosie", "samuel": "sam", "stephen": "steve", "susanna": "sue susie suzy susan", "tamsin": "tammy", "theodora": "dora thea theo teddie", "theodore": "theo", "thomas": "tom tommy",
    "timothy": "tim", "ulrik": "uli ulli", "victoria": "vicky", "william": "bill billy will willy willie liam", "wilhelmina": "mina", "xenia": "xena xeni", "zoltan": "zoli",
}
# Letters of other scripts that look like Latin ones.
LOOKALIKES = str.maketrans("аеіорсухкмтнвАЕІОРСУХКМТНВЅѕјЈԁɡοαειυνκρτΟΑΕΙΥΝΚΡΤøØłŁđĐßæœ", "aeiopcyxkmthbAEIOPCYXKMTHBSsjJdgoaeiuvkptOAEIYNKPToOlLdDsao")
# Spellings that stand for no artist, and titles that name no particular work.
NO_ARTIST = frozenset("unknown,unknownartist,variousartists,various,va,misc,miscellaneous,na,none,null,artist,anonymous,anon,traditional,trad,compilation,ost,soundtrack,tba,tbd,noartist,unnamed".split(","))
NO_TITLE = frozenset("untitled,unknown,demo,newsong,testexport,test,song,track,na,none,null,notitle,export,newtrack,noname,midi,file,tune,piece,newfile,temp".split(","))
FORMS = "prelude waltz fugue etude sonata rondo nocturne serenade ballade gavotte impromptu minuet march reel jig mazurka polonaise scherzo toccata exercise study song tune piece track movement allegro andante adagio"
_FORM = "(?:" + "|".join(FORMS.split()) + ")"
_BARE = re.compile(rf"^(?:track|exercise|song|piece|movement|test|demo|untitled|take|midi|file)?(?:no)?\d*$|^{_FORM}(?:no)?\d*(?:in)?(?:[a-g](?:flat|sharp)?(?:major|minor)?)?$|^(?:in)?[a-g](?:flat|sharp)?(?:major|minor)$")

_SHORT = {s: w for w, ss in ENSEMBLE.items() for s in (*ss, w)}
_ACRONYMS = {x + y for x in {w[0] for w in ENSEMBLE} for y in {w[0] for w in ENSEMBLE} - set("aeiou") | {"o", "e"}} - set(_SHORT)
_GIVEN = {n: full for full, names in NICKNAMES.items() for n in names.split()}
_ROMAN = {"i": "1", "ii": "2", "iii": "3", "iv": "4", "v": "5", "vi": "6", "vii": "7", "viii": "8", "ix": "9", "x": "10"}


def distance(a: str, b: str, most: int) -> int:
    """Edits between two strings, a swap of neighbours counting as one; most + 1 if there are more than `most`."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, last = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
        before, last = last, row
    return min(last[-1], most + 1)


def fold(name: str) -> str:
    """Repairs UTF-8 read as Latin-1, folds look-alike letters and accents, drops invisible characters."""
    if name.isascii():
        return name
    if re.search("[ÃÂ]|ã[\x80-\xbf]", name):
        name = re.sub("ã(?=[\x80-\xbf])", "Ã", name)
        for enc in ("latin-1", "cp1252"):
            try:
                name = name.encode(enc).decode("utf-8")
                break
            except UnicodeError:
                pass
    name = unicodedata.normalize("NFKD", name.translate(LOOKALIKES))
    return "".join(c for c in name if not unicodedata.combining(c) and unicodedata.category(c) != "Cf")


def _words(text: str) -> list[str]:
    cut = re.sub(r"(?<=[a-z])(?=[A-Z])", " ", text)
    if cut != text and sum(map(str.isupper, text)) <= sum(map(str.islower, text)):
        text = cut
    return re.findall(r"[a-z0-9]+", text.lower())


@lru_cache(200_000)
def _ensemble_word(token: str) -> str | None:
    if token in _SHORT:
        return _SHORT[token]
    if len(token) >= 3:
        return next((w for w in ENSEMBLE if (len(token) >= 4 and len(w) >= 4 or len(w) <= 4 and w[0] == token[0]) and distance(token, w, 1) <= 1), None)
    return None


def _peel(token: str) -> list[str]:
    """Ensemble words run together with a name: those it ends or begins with are cut off."""
    tail: list[str] = []
    while hit := next((w for w in ENSEMBLE if len(token) > len(w) + 2 and token.endswith(w) and (w not in ADJECTIVES or tail and tail[0] != "philharmonic")), None):
        tail.insert(0, hit)
        token = token[: -len(hit)]
    return [token, *tail]


def parse_artist(name: str) -> dict:
    """core: name tokens in typed order; kind: sorted ensemble words; initials; keys: the forms to look up, typed order first."""
    text = re.sub(r"^\s*(?:by|arr|comp|perf|feat|ft)(?:\.[\s_-]*|[\s_-]+)", "", fold(name), flags=re.I)
    tokens = _words(text)
    if len(tokens) > 1 and tokens[0] == "the":
        tokens = tokens[1:]
    if len(tokens) > 1 and tokens[-1] == "the":
        tokens = tokens[:-1]
    flat = "".join(tokens)
    if not flat or flat in NO_ARTIST:
        return {"core": [], "kind": [], "initials": [], "keys": []}
    tokens = [t for t in tokens if t not in ("of", "from")] or tokens
    tokens = [p for t in tokens for p in (_peel(t) if len(tokens) == 1 else [t])]
    typed = [t for t in tokens if _ensemble_word(t)] if len(tokens) > 1 else []
    kind = [_ensemble_word(t) for t in typed]
    if kind and kind[-1] in ADJECTIVES and typed[-1] != kind[-1]:  # the last word names the ensemble: an abbreviation there is a noun's, if one begins so
        kind[-1] = next((w for w in ENSEMBLE if w not in ADJECTIVES and w.startswith(typed[-1])), kind[-1])
    if len(kind) == len(tokens):
        kind = kind[:-1]
    rest = [t for t in tokens if not (len(tokens) > 1 and _ensemble_word(t))] or tokens[-1:]
    acronym = [t for t in rest if not kind and len(rest) > 1 and t in _ACRONYMS]
    core = [_GIVEN.get(t, t) for t in rest if len(t) > 1 and t not in acronym]
    initials = [c for t in rest if len(t) == 1 or t in acronym for c in t]
    if not core:
        return {"core": [], "kind": [], "initials": [], "keys": []}
    # typed order first, the rotations (a typo may change the sorted order), and the sorted order, in which all orders meet
    keys = ["".join(core[i:] + core[:i]) for i in range(len(core))] + ["".join(sorted(core))]
    return {"core": core, "kind": sorted(kind), "initials": initials, "keys": list(dict.fromkeys(keys))}


_KEY = r"([a-g])(flat|sharp|b)?(major|minor|maj|min|m)?"


@lru_cache(100_000)
def _title_word(t: str) -> str:
    if len(t) >= 4 and t not in ("part", "minor", "major", "flat", "sharp"):
        return next((w for w in ("part", "minor", "major", "flat", "sharp") if distance(t, w, 1) <= 1), t)
    return t


def parse_title(name: str) -> dict:
    """sig: number, part and key of the work; keys: the rest as one string, typed order first; bone: first letter and last three of each word."""
    text = fold(name)
    parts = [p for p in re.split(r"\s+-+\s+|_+-+_+|---+|\s+[–—]\s+", text) if p.strip(" _-.")]
    parts = [p for p in parts if not re.fullmatch(r"[\s_]*\d{1,3}[\s_.]*|[\s_-]*take[\s_-]*\d+[\s_]*", p, flags=re.I)] or parts
    text = parts[-1]
    text = re.sub(r"[(\[](?:live|arr\.?|arranged|piano|session|demo|remaster(?:ed)?|version|cover|solo|midi|karaoke|take[\s_-]*\d*|alt\.?|edit|mix|v\d+|copy|final)[)\]]", " ", text, flags=re.I)
    text = re.sub(r"(?:[\s_-]+(?:final|copy|take[\s_-]*\d+|live|demo|version|remastered))+[\s_]*$", "", text, flags=re.I)
    text = re.sub(r"^[\s_]*\d{1,3}(?:[\s._)-]+|(?=[A-Za-z]))(?=.*[A-Za-z]{3})", "", text)
    text = re.sub(r"\s*&\s*|\s+'?n'?\s+", " and ", text)
    text = re.sub(r"\bo'\s*", "of ", text)
    text = re.sub(r"(?:#|\bno?r?[._\s-]*|\bnum(?:ber)?[._\s-]*|\bnº\s*)(\d+)", r" no \1 ", text, flags=re.I)
    text = re.sub(r"\b([A-Ga-g])#(m?)\b", r"\1 sharp \2", text)
    text = re.sub(r"\b([A-Ga-g])#(m?)(?=$|\s)", r"\1 sharp \2", text)
    contracted = re.search(r"\b[A-Za-z]+'[A-Za-z]{2,}", text) is not None and re.search(r"'s\b", text) is None
    swapped = re.match(r"^\s*(.+?)\s*,[\s_-]*([^,]+?)\s*$", text)
    if swapped and re.match(r"(?:p\w{0,4}|part|pt\.?)[\s._-]*(?:[ivx]+|\d+)$", swapped.group(2), flags=re.I):
        swapped = None
    words = [_title_word(t) for t in _words(text.replace("'", ""))]
    turned = [_title_word(t) for t in _words(f"{swapped.group(2)} {swapped.group(1)}".replace("'", ""))] if swapped else None

    def reduce(tokens: list[str]) -> tuple[str, str, list[str]]:
        while len(tokens) > 1 and tokens[0] == "the":
            tokens = tokens[1:]
        while len(tokens) > 1 and tokens[-1] == "the":
            tokens = tokens[:-1]
        flat = re.sub(r"^the(?=[a-z]{8})", "", "".join(tokens))
        sig = ["", "", ""]
        if m := re.search(r"(?:part|pt)(\d+|i{1,3}|iv|vi{0,3}|ix|x)$", flat):
            sig[1] = _ROMAN.get(m.group(1), m.group(1).lstrip("0") or "0")
            flat = flat[: m.start()]
        if m := re.search(rf"(?:no|nr|n)?(\d+)(?:in)?(?:{_KEY})?$", flat):
            sig[0] = m.group(1).lstrip("0") or "0"
            if m.group(2):
                sig[2] = m.group(2) + {"flat": "b", "b": "b", "sharp": "s", None: ""}[m.group(3)] + ("m" if (m.group(4) or "").startswith("m") and not (m.group(4) or "").startswith("maj") else "")
            flat = flat[: m.start()]
        bone = [t[0] + t[-3:] if len(t) > 4 else t for t in tokens if t not in ("no", "part", "in", "the")]
        return "|".join(sig), flat, bone

    whole = "".join(words)
    if not whole or whole in NO_TITLE or _BARE.match(whole):
        return {"sig": "", "keys": [], "bone": "", "contracted": False}
    sig, flat, bone = reduce(words)
    keys = [flat]
    if turned:
        sig2, flat2, _ = reduce(turned)
        if len(sig2) > len(sig):
            sig, keys = sig2, [flat2]
        elif sig2 == sig:
            keys.append(flat2)
    keys = [k for k in dict.fromkeys(keys) if k]
    if not keys or (len(keys[0]) < 3 and sig == "||"):
        return {"sig": "", "keys": [], "bone": "", "contracted": False}
    return {"sig": sig, "keys": keys, "bone": "|".join([*bone, sig]) if len(bone) > 1 else "", "contracted": contracted}


_PARSED = "id long, field string, name string, space string, keys array<string>, core array<string>, kind string, initials string, bone string, contracted boolean"


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for i, field, name in zip(batch["id"].tolist(), batch["field"].tolist(), batch["name"].tolist()):
            if field == "artist":
                p = parse_artist(name)
                if p["keys"]:
                    rows.append((i, field, name, "a:" + " ".join(p["kind"]), p["keys"], p["core"], " ".join(p["kind"]), "".join(p["initials"]), "", False))
            else:
                p = parse_title(name)
                if p["keys"]:
                    rows.append((i, field, name, "t:" + p["sig"], p["keys"], p["keys"][:1], "", "", p["bone"], p["contracted"]))
        yield pd.DataFrame(rows, columns=["id", "field", "name", "space", "keys", "core", "kind", "initials", "bone", "contracted"])


def parsed_names(records: DataFrame) -> DataFrame:
    """The distinct strings of artist and title that name something, parsed; placeholders, nulls and blanks have no row."""
    names = records.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("name")) for c in ("artist", "title")])).alias("x")).select("x.*").where("name IS NOT NULL").distinct()
    return names.select(F.xxhash64("field", "name").alias("id"), "field", "name").mapInPandas(_parse, _PARSED)


class Trie:
    """Keys as nested dicts; `None` holds the ids of the keys that end there."""

    def __init__(self) -> None:
        self.root: dict = {}

    def add(self, key: str, ident: int) -> None:
        node = self.root
        for c in key:
            node = node.setdefault(c, {})
        node.setdefault(None, []).append(ident)

    def near(self, key: str, k: int) -> Iterator[int]:
        """Ids of all keys within k (1 or 2) insertions, deletions, substitutions and swaps of neighbours, by running the Levenshtein automaton of `key`.

        States are bits: bit i of r0, r1, r2 says that i letters of `key` are matched after 0, 1, 2 edits; bit i of h1, h2
        that a swap has begun there, whose second letter has been read and whose first is due. A branch of the trie ends
        where no bit is left.
        """
        n, at = len(key), letter_places(key)
        full = (2 << n) - 1
        stack = [(self.root, 1, 3, 7 if k > 1 else 0, 0, 0)]
        while stack:
            node, r0, r1, r2, h1, h2 = stack.pop()
            for c, child in node.items():
                if c is None:
                    if (r0 | r1 | r2) >> n & 1:
                        yield from child
                    continue
                m = at.get(c, 0)
                s0 = (r0 & m) << 1
                s1 = ((r1 & m) << 1 | r0 | (r0 | s0) << 1 | (h1 & m) << 2) & full
                s2 = ((r2 & m) << 1 | r1 | (r1 | s1) << 1 | (h2 & m) << 2) & full if k > 1 else 0
                if s0 or s1 or s2:
                    stack.append((child, s0, s1, s2, r0 & m >> 1, r1 & m >> 1))


@lru_cache(50_000)
def letter_places(key: str) -> dict[str, int]:
    """Of each letter of the key a number whose bits are its places."""
    out: dict[str, int] = {}
    for i, c in enumerate(key):
        out[c] = out.get(c, 0) | 1 << i
    return out


@lru_cache(1000)
def _segments(n: int, parts: int) -> list[tuple[int, int]]:
    cut = [n * i // parts for i in range(parts + 1)]
    return list(zip(cut, cut[1:]))


def _reach(n: int) -> int:
    return EDITS if n >= LONG else 1


def _pieces(key: str, m: int) -> Iterator[tuple[int, str]]:
    """(piece, text) by which a key of m letters within its edit bound of `key` can be found.

    From LONG letters on: of k + 1 pieces one is unchanged that has as many edits before it as pieces (the first up to
    which fewer pieces than edits don't occur), and at most the others behind it; that bounds its shift. A swap over a cut
    changes two pieces; if another edit takes the third, undoing the swap gives one of the two.
    """
    n, k = len(key), _reach(m)
    cuts, more = _segments(m, k + 1), n - m
    for s, (a, b) in enumerate(cuts):
        for d in range(-k, k + 1) if k == 1 else range(max(-s, more - (k - s)), min(s, more + (k - s)) + 1):
            if a + d >= 0 and b + d <= n:
                yield s, key[a + d : b + d]
    if k == 1 and m == n:
        for (a, b), (_, z) in zip(cuts, cuts[1:]):
            if a < b < z:
                yield 0, key[a : b - 1] + key[b]
    elif k == 2 and abs(more) < 2:
        b, c = cuts[0][1], cuts[2][0] + more
        yield 0, key[: b - 1] + key[b]
        yield 2, key[c - 1] + key[c + 1 :]


def _shards(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each index key under its k + 1 pieces, each probe under the pieces a key of its length or up to k shorter or longer could share with it."""
    for batch in batches:
        rows = []
        for ident, space, key, role in batch[["id", "space", "key", "role"]].itertuples(index=False):
            n = len(key)
            if role == "index":
                for s, (a, b) in enumerate(_segments(n, _reach(n) + 1)):
                    rows.append((f"{space}\t{n}\t{s}\t{key[a:b]}", ident, key, 0))
            else:
                near = [m for m in range(max(1, n - EDITS), n + EDITS + 1) if abs(m - n) <= _reach(m)]
                rows.extend((x, ident, key, 1) for x in {f"{space}\t{m}\t{s}\t{piece}" for m in near for s, piece in _pieces(key, m)})
        yield pd.DataFrame(rows, columns=["shard", "id", "key", "probe"])


@lru_cache(50_000)
def letters_mask(key: str) -> int:
    """A bit for the first, second, .. occurrence of every letter; an edit changes two bits at most, a swap none."""
    mask, often = 0, {}
    for c in key:
        often[c] = n = often.get(c, 0) + 1
        mask |= 1 << (ord(c) + 23 * n) % 128
    return mask


def _match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by shard, index keys before probes: builds a shard's trie, runs its probes, forgets it.

    A probe whose letters differ too much from those of every key of another id in a small shard is not run: the
    automaton couldn't accept. The trie is built for the first probe that is run.
    """
    shard, trie, held = None, None, []
    for batch in batches:
        out = set()
        for x, ident, key, probe in zip(*(batch[c].tolist() for c in ("shard", "id", "key", "probe"))):
            if x != shard:
                shard, trie, held = x, None, []
            if not probe:
                held.append((key, ident, letters_mask(key)))
            elif held:
                k = _reach(len(key))
                own, most = letters_mask(key), 2 * k
                if len(held) > FEW_KEYS or any((own ^ m).bit_count() <= most and other != ident for _, other, m in held):
                    if trie is None:
                        trie = Trie()
                        for text, other, _ in held:
                            trie.add(text, other)
                    out.update((ident, other) for other in trie.near(key, k) if other != ident)
        yield pd.DataFrame(sorted(out), columns=["a", "b"])


def trie_join(index: DataFrame, probes: DataFrame, same: bool = False) -> DataFrame:
    """`id`, `space`, `key` on both sides -> distinct `a` (probe id), `b` (index id) of keys of one space within the edit bound.

    `same` says that both sides hold the same ids: a shard of one key and its own probe is then skipped.
    """
    both = index.select("id", "space", "key", F.lit("index").alias("role")).unionByName(probes.select("id", "space", "key", F.lit("probe").alias("role")))
    whole = W.partitionBy("shard")
    rows = both.mapInPandas(_shards, "shard string, id long, key string, probe int")
    rows = rows.withColumns({"keys": F.sum(1 - F.col("probe")).over(whole), "probes": F.sum("probe").over(whole)}).where(f"keys > 0 AND probes > 0 AND keys + probes > {2 if same else 1}")
    # a hot shard becomes a grid: each slice of its keys is a trie for every slice of its probes
    slices = [F.greatest(F.lit(1), F.ceil(F.col(c) / most)).cast("int").alias(name) for c, most, name in (("keys", TRIE_KEYS, "tries"), ("probes", TRIE_PROBES, "lanes"))]
    rows = rows.select("shard", "id", "key", "probe", *slices)
    own = lambda c: F.pmod(F.xxhash64("id", "key"), F.col(c)).cast("int")
    every = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    index = F.col("probe") == 0
    cell = F.when(index, F.transform(every("lanes"), lambda x: F.struct(own("tries").alias("t"), x.alias("l")))).otherwise(F.transform(every("tries"), lambda x: F.struct(x.alias("t"), own("lanes").alias("l"))))
    rows = rows.select(F.explode(cell).alias("cell"), "shard", "id", "key", "probe").select(F.concat_ws("\t", "shard", F.col("cell.t").cast("string"), F.col("cell.l").cast("string")).alias("shard"), "id", "key", "probe")
    return rows.repartition("shard").sortWithinPartitions("shard", "probe").mapInPandas(_match, "a long, b long").distinct()


def tokens_agree(a: list[str], b: list[str]) -> bool:
    """Whether some order of b's tokens agrees with a's, token by token: up to 1 edit a token (2 from 8 letters on), EDITS in all."""
    if len(a) != len(b):
        return distance("".join(a), "".join(b), EDITS) <= EDITS
    if len(a) == 1:
        return distance(a[0], b[0], EDITS) <= (EDITS if min(len(a[0]), len(b[0])) >= LONG else 1)

    def fit(rest: list[str], others: list[str], left: int) -> bool:
        if not rest:
            return True
        for n, o in enumerate(others):
            most = min(left, 2 if min(len(o), len(rest[0])) >= 8 else 1)
            d = distance(rest[0], o, most)
            if d <= most and fit(rest[1:], others[:n] + others[n + 1 :], left - d):
                return True
        return False

    return fit(a, b, EDITS)


def _agree(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        keep = []
        for field, ca, cb, ia, ib in batch[["field", "core_a", "core_b", "initials_a", "initials_b"]].itertuples(index=False):
            if field == "title":
                keep.append(True)
                continue
            ca, cb = list(ca), list(cb)
            # a middle initial may be missing on one side; two different ones are two people
            ok = not (ia and ib and sorted(ia) != sorted(ib))
            keep.append(ok and tokens_agree(ca, cb))
        yield batch.loc[keep, ["a", "b"]]


def name_links(parsed: DataFrame) -> DataFrame:
    """Links `a`, `b` between the ids of distinct strings that name the same entity. `parsed` should be materialised.

    1. Equal keys are linked to the smallest id of the key, so a much-repeated key costs one link a string.
    2. One representative a key goes through the trie join; token order and initials are checked on what it finds.
    3. Forms with only an initial for the given name are linked where exactly one fuller name fits, contracted words
       (Q'fen) where exactly one title fits, and ensembles typed with an initial (C. Band) likewise.
    """
    full = parsed.where("field = 'title' OR size(core) > 1 OR kind <> '' OR initials = ''")
    main = full.select("id", "space", F.col("keys")[0].alias("key"), F.col("initials"))
    head = main.groupBy("space", "key", "initials").agg(F.min("id").alias("head"))
    equal = main.join(head, ["space", "key", "initials"]).where("id <> head").select(F.col("head").alias("a"), F.col("id").alias("b"))
    reps = full.join(head.select(F.col("head").alias("id")), "id", "left_semi")
    found = trie_join(reps.select("id", "space", F.explode("keys").alias("key")), reps.select("id", "space", F.explode(F.array_distinct(F.when(F.size("core") > 2, F.array(F.col("keys")[0], F.element_at("keys", -1))).otherwise(F.array(F.col("keys")[0])))).alias("key")), same=True)
    info = reps.select("id", "field", "core", "initials")
    checked = (
        found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        .join(info.select(F.col("id").alias("a"), "field", F.col("core").alias("core_a"), F.col("initials").alias("initials_a")), "a")
        .join(info.select(F.col("id").alias("b"), F.col("core").alias("core_b"), F.col("initials").alias("initials_b")), "b")
        .mapInPandas(_agree, "a long, b long")
    )
    sure = materialise(equal.unionByName(checked), "namelinks")
    classes = materialise(components(sure.select(F.col("a").alias("src"), F.col("b").alias("dst"))), "nameclasses")
    return sure.unionByName(_initial_links(parsed, classes)).unionByName(_contraction_links(parsed, classes))


def _unique(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Of `a` -> `b`, those of an `a` whose `b` all lie in one class."""
    named = pairs.join(classes.select(F.col("node").alias("b"), "root"), "b", "left").select("a", F.coalesce("root", "b").alias("root"))
    return named.groupBy("a").agg(F.min("root").alias("b"), F.max("root").alias("most")).where("b = most").select("a", "b")


def _initial_links(parsed: DataFrame, classes: DataFrame) -> DataFrame:
    """R. Name, Name R., and X C. Band, where exactly one class of fuller names fits."""
    artists = parsed.where("field = 'artist'")
    person = artists.where("kind = '' AND size(core) > 1")
    short = artists.where("kind = '' AND size(core) = 1 AND initials <> ''")
    # every name token of a person, with the letters the other tokens begin with
    token = person.select("id", "core", "initials", F.posexplode("core").alias("at", "key"))
    others = F.expr("filter(core, (t, i) -> i <> at)")
    token = token.select("id", "key", F.concat_ws("", F.transform(others, lambda t: F.substring(t, 1, 1)), "initials").alias("letters"))
    toks = token.groupBy("key").agg(F.min("id").alias("id"))
    probes = short.select("id", F.lit("i").alias("space"), F.col("core")[0].alias("key"))
    near = trie_join(toks.select("id", F.lit("i").alias("space"), "key"), probes)
    hit = near.join(toks.select(F.col("id").alias("b"), "key"), "b").join(token.withColumnRenamed("id", "p"), "key")
    hit = hit.join(short.select(F.col("id").alias("a"), F.col("initials").alias("want"), F.col("core")[0].alias("typed")), "a")
    hit = hit.where(F.col("letters").startswith(F.substring("want", 1, 1)) & (F.levenshtein("typed", "key") <= 2)).select("a", F.col("p").alias("b"))
    # ensembles: one word of the kind typed as an initial
    band = artists.where("kind <> ''")
    word = F.explode(F.split("kind", " ")).alias("word")
    fuller = band.select("id", F.concat_ws(" ", "core").alias("core"), F.split("kind", " ").alias("kinds"), word)
    fuller = fuller.select(F.col("id").alias("b"), "core", F.concat_ws(" ", F.array_remove("kinds", F.col("word"))).alias("kind"), F.substring("word", 1, 1).alias("initials"))
    tight = band.where("initials <> ''").select(F.col("id").alias("a"), F.concat_ws(" ", "core").alias("core"), "kind", "initials")
    hit = hit.unionByName(tight.join(fuller, ["core", "kind", "initials"]).where("a <> b").select("a", "b"))
    # and all of them: X BB
    letters = F.array_join(F.array_sort(F.transform(F.split("kind", " "), lambda w: F.substring(w, 1, 1))), "").alias("letters")
    spelt = band.where("initials = ''").select(F.col("id").alias("b"), F.concat_ws(" ", "core").alias("core"), letters)
    acronym = short.where("length(initials) > 1").select(F.col("id").alias("a"), F.concat_ws(" ", "core").alias("core"), F.array_join(F.array_sort(F.split("initials", "")), "").alias("letters"))
    hit = hit.unionByName(acronym.join(spelt, ["core", "letters"]).select("a", "b"))
    return _unique(hit.distinct(), classes)


def _contraction_links(parsed: DataFrame, classes: DataFrame) -> DataFrame:
    titles = parsed.where("field = 'title' AND bone <> ''")
    a = titles.where("contracted").select(F.col("id").alias("a"), "bone")
    b = titles.where("NOT contracted").select(F.col("id").alias("b"), "bone")
    # one row a bone and class first, so that no bone multiplies its spellings
    named = b.join(classes.select(F.col("node").alias("b"), "root"), "b", "left").select("bone", F.coalesce("root", "b").alias("root"))
    fold = named.groupBy("bone").agg(F.min("root").alias("b"), F.max("root").alias("most")).where("b = most").select("bone", "b")
    return a.join(fold, "bone").select("a", "b")


def name_classes(records: DataFrame) -> DataFrame:
    """`field`, `name`, `class_id`, `id`: one row per distinct string of artist and title that names something.

    Strings of one entity share class_id. Placeholders, nulls and blanks get no row; an empty table gives no rows.
    """
    parsed = materialise(parsed_names(records), "names")
    cls = components(name_links(parsed).select(F.col("a").alias("src"), F.col("b").alias("dst")))
    return materialise(parsed.select("id", "field", "name").join(cls.select(F.col("node").alias("id"), "root"), "id", "left").select("field", "name", F.coalesce("root", "id").alias("class_id"), "id"), "entities")


def name_pairs(records: DataFrame) -> DataFrame:
    """`field`, `name_a`, `name_b` (smaller first by code point): all pairs of different strings of one entity."""
    cls = name_classes(records)
    a = cls.select("field", "class_id", F.col("name").alias("name_a"))
    b = cls.select("field", "class_id", F.col("name").alias("name_b"))
    return a.join(b, ["field", "class_id"]).where("name_a < name_b").select("field", "name_a", "name_b")
