"""Blocks, loops and data flow against a work list over single functions."""

import random

from quantalog.operators import controlflow


def plain(code):
    """code: list of (addr, cls, target, reads, writes) of one function. (block of each address, edges, uses)."""
    places = {c[0]: n for n, c in enumerate(code)}
    lead = {0} | {n + 1 for n, c in enumerate(code) if c[1] in ("cbr", "jmp", "ret")} | {places[c[2]] for c in code if c[1] in ("cbr", "jmp") and c[2] in places and c[2] != c[0]}
    block, of = -1, []
    for n in range(len(code)):
        block += n in lead
        of.append(block)
    edges = set()
    for n, (_, cls, target, _, _) in enumerate(code):
        if n + 1 == len(code) or of[n + 1] != of[n]:
            if cls in ("cbr", "jmp") and target in places:
                edges.add((of[n], of[places[target]]))
            if cls not in ("jmp", "ret") and n + 1 < len(code):
                edges.add((of[n], of[n] + 1))
    writes, reads = {}, {}
    for n, (_, _, _, r, w) in enumerate(code):
        reads.setdefault(of[n], set()).update(x for x in r if x not in writes.get(of[n], set()))
        writes.setdefault(of[n], set()).update(w)
    into = {b: set() for b in range(block + 1)}
    todo = [(b, (r, a)) for a, b in edges for r in writes.get(a, ())]
    while todo:
        b, fact = todo.pop()
        if fact not in into[b]:
            into[b].add(fact)
            if fact[0] not in writes.get(b, ()):
                todo += [(to, fact) for at, to in edges if at == b]
    return of, edges, {(d, b) for b, facts in into.items() for r, d in facts if r in reads.get(b, ()) and d != b}


def test_functions(spark):
    rng = random.Random(11)
    functions = {f: [] for f in range(25)}
    for f, code in functions.items():
        for n in range(rng.randint(1, 30)):
            cls = rng.choice(["mov", "alu", "alu", "cbr", "jmp", "ret", "call"])
            target = rng.choice([None, 4 * rng.randrange(32), 4 * n]) if cls in ("cbr", "jmp", "call") else None
            code.append((4 * n, cls, target, rng.sample("abcd", rng.randint(0, 2)), rng.sample("abcd", rng.randint(0, 1))))
    rows = [(f, a, c, t) for f, code in functions.items() for a, c, t, _, _ in code]
    registers = [(f, a, r, w) for f, code in functions.items() for a, _, _, rs, ws in code for w, names in ((False, rs), (True, ws)) for r in names]
    held = controlflow.blocks(spark.createDataFrame(rows, "func long, addr long, cls string, target long").repartition(5))
    edges = controlflow.flow(held)
    uses = controlflow.reaching(held, edges, spark.createDataFrame(registers, "func long, addr long, reg string, written boolean"))
    expected = {f: plain(code) for f, code in functions.items()}
    assert {(r.func, r.addr): r.block for r in held.collect()} == {(f, c[0]): b for f, code in functions.items() for c, b in zip(code, expected[f][0], strict=True)}
    assert {tuple(r) for r in edges.collect()} == {(f, *e) for f, x in expected.items() for e in x[1]}
    assert {tuple(r) for r in uses.collect()} == {(f, *u) for f, x in expected.items() for u in x[2]}
    assert controlflow.flow(controlflow.blocks(spark.createDataFrame([], "func long, addr long, cls string, target long"))).count() == 0


def test_loops(spark):
    """functions whose cycles lie within a few blocks, of 63 too, and all others have the loops that single functions have."""
    rng = random.Random(5)
    edges = {(f, rng.randrange(100, 100 + n), rng.randrange(100, 100 + n)) for f, n in enumerate([1, 2, 3, 5, 8, 20, 63, 64, 90] * 3) for _ in range(n + n // 5)}
    edges |= {(50, k, (k + 1) % 63) for k in range(63)} | {(51, k, (k + 1) % 64) for k in range(64)} | {(52, 3, 3), (53, 0, 1), (53, 1, 2)}
    reach = {}
    for f, a, b in edges:
        reach.setdefault(f, {}).setdefault(a, set()).add(b)
    expected = set()
    for f, to in reach.items():
        seen = {}
        for start in to:
            todo, seen[start] = list(to[start]), set()
            while todo:
                if (b := todo.pop()) not in seen[start]:
                    seen[start].add(b)
                    todo += to.get(b, ())
        expected |= {(f, min(y for y in x if a in seen.get(y, ())), a) for a, x in seen.items() if a in x}
    given = spark.createDataFrame(sorted(edges), "func long, a long, b long").repartition(5)
    for bits in (63, 2, 0):
        assert {tuple(r) for r in controlflow.loops(given, bits).collect()} == expected
