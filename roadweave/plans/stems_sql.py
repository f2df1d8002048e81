"""The stemmer's steps as SQL over a table of words, made from its rule tables."""

from __future__ import annotations

from roadweave.operators import stemming as st


def _shape(w: str) -> str:
    """v for a vowel, # for a consonant of each letter: y is Y where it is a consonant."""
    y = f"regexp_replace(regexp_replace(regexp_replace({w}, '^y', 'Y'), '([aeiou])y', '\\1Y', 'g'), 'yy', 'yY', 'g')"
    return f"regexp_replace(regexp_replace({y}, '[^aeiouy]', '#', 'g'), '[aeiouy]', 'v', 'g')"


def _measure(w: str) -> str:
    return f"len(regexp_extract_all({_shape(w)}, 'v+#+'))"


def _short(w: str) -> str:
    return f"((regexp_matches({_shape(w)}, '#v#$') AND NOT regexp_matches({w}, '[wxy]$')) OR {_shape(w)} = 'v#')"


def _cut(w: str, n: int) -> str:
    return f"left({w}, len({w}) - {n})"


def _case(rules: list[tuple[str, str]], w: str = "w") -> str:
    return "CASE " + " ".join(f"WHEN {condition} THEN {value}" for condition, value in rules) + f" ELSE {w} END"


def _ends(suffix: str, w: str = "w") -> str:
    return f"suffix({w}, '{suffix}')"


def _replacing(rules: tuple[tuple[str, str], ...]) -> str:
    def one(a: str, b: str) -> str:
        before = _cut("w", len(a) - (a == "logi"))
        return f"CASE WHEN {_measure(before)} > 0 THEN {_cut('w', len(a))} || '{b}' ELSE w END"

    return _case([(_ends(a), one(a, b)) for a, b in rules])


def stem_steps(words: str, out: str = "stems", least: int = st.LEAST) -> str:
    """CTEs that end in ``out`` (word, stem) for the distinct words of the CTE ``words`` (word)."""
    past = _case([("suffix(w, 'ied')", f"CASE WHEN len(w) = 4 THEN {_cut('w', 1)} ELSE {_cut('w', 2)} END"), ("suffix(w, 'eed')", f"CASE WHEN {_measure(_cut('w', 3))} > 0 THEN {_cut('w', 1)} ELSE w END")], "NULL")
    stripped = _case([(f"{_ends(e)} AND contains({_shape(_cut('w', len(e)))}, 'v')", _cut("w", len(e))) for e in ("ed", "ing")], "NULL")
    repaired = _case(
        [(_ends(a, "c"), f"{_cut('c', len(a))} || '{b}'") for a, b in st.REPAIRS]
        + [(f"right(c, 1) = left(right(c, 2), 1) AND len(c) > 1 AND suffix({_shape('c')}, '#')", f"CASE WHEN regexp_matches(c, '[lsz]$') THEN c ELSE {_cut('c', 1)} END"), (f"{_measure('c')} = 1 AND {_short('c')}", "c || 'e'")], "c"
    )
    plural = _case([("suffix(w, 'ies') AND len(w) = 4", _cut("w", 1))] + [(_ends(a), f"{_cut('w', len(a))} || '{b}'") for a, b in st.PLURALS])
    endings = _case([(_ends(a), f"CASE WHEN {_measure(_cut('w', len(a)))} > 1" + (f" AND regexp_matches({_cut('w', 3)}, '[st]$')" if a == "ion" else "") + f" THEN {_cut('w', len(a))} ELSE w END") for a in st.ENDINGS])
    e = _cut("w", 1)
    last = f"CASE WHEN suffix(w, 'e') AND ({_measure(e)} > 1 OR ({_measure(e)} = 1 AND NOT {_short(e)})) THEN {e} ELSE w END"
    ll = f"CASE WHEN suffix(w, 'll') AND {_measure(e)} > 1 THEN {e} ELSE w END"
    y = f"CASE WHEN len(w) > 2 AND suffix(w, 'y') AND suffix({_shape(e)}, '#') THEN {e} || 'i' ELSE w END"
    alli = f"CASE WHEN suffix(w, 'alli') AND {_measure(_cut('w', 4))} > 0 THEN {_cut('w', 2)} ELSE w END"
    odd = "CASE word " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in st.IRREGULAR.items()) + " ELSE w END"
    steps = [f"SELECT word, word AS w FROM (SELECT DISTINCT word FROM {words}) WHERE len(word) >= {max(least, 3)}", f"SELECT word, {plural} AS w FROM {{}}"]
    steps += [f"SELECT word, w, {past} AS p, {stripped} AS c FROM {{}}", f"SELECT word, coalesce(p, CASE WHEN c IS NULL THEN w ELSE {repaired} END) AS w FROM {{}}"]
    steps += [f"SELECT word, {x} AS w FROM {{}}" for x in (y, alli, _replacing(st.DOUBLE_SUFFIXES), _replacing(st.SUFFIXES), endings, last, ll)]
    steps.append(f"SELECT word, {odd} AS stem FROM {{}}")
    names = [f"{out}_{i}" for i in range(len(steps) - 1)] + [out]
    return ", ".join(f"{name} AS ({step.format(names[i - 1])})" for i, (name, step) in enumerate(zip(names, steps, strict=True)))
