"""The token grammar: BOS [TEMPO] [KEY] (BAR [TEMPO] [KEY] (POS INST PITCH DUR VEL)*)* EOS.

Each token has a letter: B BOS, E EOS, R BAR, T tempo, K key, P I C D V the parts of a note, ? anything else. Whether
a token may stand at a place depends on the letter before it and on whether a bar has begun, so the first fault of a
sequence is found by array expressions, without a state machine.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from melisma.functions import numeric as N
from melisma.operators.tokens import INSTRUMENTS, ROOTS

# Which letters may follow a letter once a bar has begun, and before.
FOLLOW = {"R": "TKPRE", "T": "KPRE", "K": "PRE", "P": "I", "I": "C", "C": "D", "D": "V", "V": "PRE", "E": ""}
HEAD_FOLLOW = {"^": "B", "B": "TKRE", "T": "KRE", "K": "RE", "E": ""}
# What the faults are called, by the state before the token and for sequences that end early.
EXPECTED = {
    "^": "expected_bos", "B": "expected_tempo_key_bar_or_eos", "hT": "expected_key_bar_or_eos", "hK": "expected_bar_or_eos", "R": "expected_tempo_key_pos_bar_or_eos", "T": "expected_key_pos_bar_or_eos",
    "K": "expected_pos_bar_or_eos", "P": "expected_inst", "I": "expected_pitch", "C": "expected_dur", "D": "expected_vel", "V": "expected_pos_bar_or_eos", "E": "unexpected_token_after_eos",
}
UNFINISHED = {"P": "inst", "I": "pitch", "C": "dur", "D": "vel"}
#: State names by (letter, whether in the head, whether a tempo stands before a key).
STATES = ("expect_bos", "after_bos", "after_head_tempo", "after_head_key", "after_head_tempo_key", "after_bar", "after_bar_tempo", "after_bar_key", "after_bar_tempo_key", "after_pos", "after_inst", "after_pitch", "after_dur", "after_vel", "terminal")
# the parts of a note first, as most tokens are such
_PREFIX = (("POS_", "P"), ("INST_", "I"), ("PITCH_", "C"), ("DUR_", "D"), ("VEL_", "V"), ("TEMPO_", "T"), ("KEY_", "K"))
#: The vocabulary without the FIM tokens.
WORDS = (
    "BOS", "EOS", "BAR", *(f"POS_{i}" for i in range(N.POSITIONS)), *(f"INST_{x}" for x in INSTRUMENTS), *(f"PITCH_{i}" for i in range(N.PITCH_MIN, N.PITCH_MAX + 1)), *(f"DUR_{i}" for i in N.DURATIONS),
    *(f"VEL_{i}" for i in range(N.BINS)), *(f"TEMPO_{i}" for i in range(N.TEMPO_MIN, N.TEMPO_MAX + 1) if i % N.TEMPO_STEP == 0), *(f"KEY_{r}_{m}" for r in ROOTS for m in ("MAJ", "MIN")), "KEY_UNCERTAIN",
)


def letter(token: Column, strict: bool = True) -> Column:
    """The letter of a token; `strict` asks that the token is in the vocabulary, else the prefix decides."""
    if strict:  # one look-up; the initial tells the rest apart
        kind = F.when(token.startswith("PITCH_"), "C").when(token == "BAR", "R").otherwise(F.substring(token, 1, 1))
        return F.when(token.isin(*WORDS), kind).otherwise("?")
    kind = F
    for prefix, sign in _PREFIX:
        kind = kind.when(token.startswith(prefix), sign)
    return kind.when(token == "BAR", "R").when(token == "BOS", "B").when(token == "EOS", "E").otherwise("?")


def letters(tokens: Column, strict: bool = True) -> Column:
    return F.array_join(F.transform(tokens, lambda t: letter(t, strict)), "")


def is_oov(token: Column) -> Column:
    return ~token.isin(*WORDS, "FIM_HOLE", "FIM_MID")


def oov_count(tokens: Column) -> Column:
    return F.size(F.filter(tokens, is_oov))


def first_fault(code: Column) -> Column:
    """Index (from 0) of the first token that may not stand where it does; null if all may. `code` is a string of letters."""
    pairs = F.array(*[F.lit(a + b) for a, bs in FOLLOW.items() for b in bs])
    heads = F.array(*[F.lit(a + b) for a, bs in HEAD_FOLLOW.items() for b in bs])
    bar = F.instr(code, "R")  # from 1; 0 without a bar
    marked = F.concat(F.lit("^"), code)

    def wrong(i: Column) -> Column:
        pair = F.substring(marked, i + 1, F.lit(2))
        head = (bar == 0) | (i < bar)
        return ~F.when(head, F.array_contains(heads, pair)).otherwise(F.array_contains(pairs, pair))

    return F.when(F.length(code) > 0, F.array_min(F.filter(F.sequence(F.lit(0), F.length(code) - 1), wrong)))


#: Beginnings of whole sequences; pairs of letters that may not follow each other from there on.
_HEAD = "^BT?K?(?:R|E$)"
_ASTRAY = "|".join(f"{a}[^{bs}]" if bs else f"{a}." for a, bs in FOLLOW.items())


def prefix_valid(code: Column) -> Column:
    """Whether a string of letters is a whole sequence of the grammar: first_fault finds none and it ends with EOS, told in one pass."""
    return code.rlike(_HEAD) & ~code.rlike(_ASTRAY) & code.endswith("E")


def fault_reason(tokens: Column, code: Column, fault: Column) -> Column:
    """'ok', or the first fault with index and token, or how the sequence ends early. `code` and `fault` as from letters and first_fault."""
    before = F.when(fault == 0, "^").otherwise(F.substring(code, fault, F.lit(1)))
    bar = F.instr(code, "R")
    head = (bar == 0) | (fault < bar)
    state = F.when(head & before.isin("T", "K"), F.concat(F.lit("h"), before)).otherwise(before)
    names = F.create_map(*[F.lit(x) for kv in EXPECTED.items() for x in kv])
    token = F.try_element_at(tokens, fault + 1)
    unknown = F.substring(code, fault + 1, F.lit(1)) == "?"
    fim = token.isin("FIM_HOLE", "FIM_MID")
    at = F.concat(F.when(unknown & ~fim, F.lit("unknown_token")).otherwise(F.try_element_at(names, state)), F.lit("@"), fault.cast("string"), F.lit(":"), token)
    last = F.substring(code, -1, 1)
    ends = F.create_map(*[F.lit(x) for k, v in UNFINISHED.items() for x in (k, f"incomplete_note_tuple_expected_{v}")])
    early = F.coalesce(F.try_element_at(ends, last), F.lit("missing_eos"))
    return F.when(F.coalesce(F.length(code), F.lit(0)) == 0, "empty_sequence").when(fault.isNotNull(), at).when(last == "E", "ok").otherwise(early)


# -- states, for decoding -------------------------------------------------------------------------------------------


def step(state: str, sign: str) -> str | None:
    """The state after a letter, or None."""
    if state == "expect_bos":
        return "after_bos" if sign == "B" else None
    if state == "terminal":
        return None
    last = {"after_bos": "B", "after_pos": "P", "after_inst": "I", "after_pitch": "C", "after_dur": "D", "after_vel": "V", "after_bar": "R"}.get(state) or ("K" if state.endswith("key") else "T")
    head = state == "after_bos" or "head" in state
    if sign not in (HEAD_FOLLOW if head else FOLLOW)[last]:
        return None
    if sign in "TK":
        tempo = "_tempo" if state.endswith("tempo") and sign == "K" else ""
        return f"after_{'head' if head else 'bar'}{tempo}_{'tempo' if sign == 'T' else 'key'}"
    return {"R": "after_bar", "E": "terminal", "P": "after_pos", "I": "after_inst", "C": "after_pitch", "D": "after_dur", "V": "after_vel"}[sign]


def state_after(code: str) -> str | None:
    """The state after a prefix, from its start; None if it breaks the grammar."""
    state: str | None = "expect_bos"
    for sign in code:
        state = step(state, sign)
        if state is None:
            return None
    return state


def compatible_states(code: str) -> set[str]:
    """The states from which a suffix and then EOS ends well."""
    good = {"terminal"}
    for sign in reversed(code + "E"):
        good = {s for s in STATES if step(s, sign) in good}
        if not good:
            break
    return good


def bridgeable_states(targets: set[str]) -> set[str]:
    """The states from which one of the targets is reached without EOS."""
    good = set(targets)
    while new := {s for s in STATES if s not in good and s != "terminal" and any(step(s, x) in good for x in "BTKRPICDV")}:
        good |= new
    return good
