"""Column profiles against a loop over cells."""

import random

from ledgerproof.lang.values import Fault, coerce, decorated, number_of, shown_places
from ledgerproof.operators.profile import profile


def plain(cells):
    """As profile has it, of (place, text) pairs."""
    filled = [(p, t) for p, t in sorted(cells, key=lambda c: (c[0], c[1] or "")) if t and t.strip()]
    out = {"n": len(cells), "filled": len(filled), "nums": 0, "dates": 0, "strings": 0, "width": None, "decoration": None, "deviant_at": None, "deviant": None}
    seen, values = [], set()
    for p, t in filled:
        try:
            got = decorated(t)
        except Fault:
            got = None
        if got is None:
            try:
                kind = "dates" if not isinstance(coerce(t), str) else "strings"
            except Fault:
                kind = "strings"
            out[kind] += 1
            values.add(t.strip())
            continue
        out["nums"] += 1
        values.add(number_of(t))
        out["width"] = max(out["width"] or 0, shown_places(t))
        how = f"{got[1].prefix}|{got[1].suffix}"
        if how not in seen:
            seen.append(how)
            if len(seen) == 2:
                out["deviant_at"], out["deviant"] = p, t
    out["decorations"], out["decoration"], out["constant"] = len(seen), seen[0] if seen else None, len(values) == 1
    return out


def test_profiles_equal_a_loop(spark):
    rng = random.Random(2)
    pools = {"mixed": ["$1.50", "2.25", "7 kg", "12%", "-$3", "n/a", "2026-01-31", "2026-01", "", None, " 4.125 "], "same": ["5.0", "5.00", " 5", "", None], "late": ["1.5"], "void": ["", None, " "], "words": ["a", "b c"]}
    rows = [(k, *[rng.choice(pool) for pool in pools.values()]) for k in range(400)]
    rows[317] = (317, *rows[317][1:3], "€1.5", *rows[317][4:])
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "at long, " + ", ".join(f"{c} string" for c in pools)).repartition(5)
    got = {r["column"]: r.asDict() for r in profile(frame, list(pools), "at").collect()}
    for k, c in enumerate(pools, 1):
        want = plain([(r[0], r[k]) for r in rows])
        assert {n: got[c][n] for n in want} == want, c
    assert got["late"]["deviant_at"] == 317
    assert profile(frame.limit(0), ["mixed"], "at").collect() == []
