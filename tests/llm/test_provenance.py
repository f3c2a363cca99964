import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lexisift.llm import provenance as pv
from lexisift.llm.grammar import Grammars

PROTO = "package p\n\ntype M struct {\n" + "".join(f'\tField{i:03} int64 `wire:"varint,{i},opt"`\n' for i in range(60)) + "}\n" + "".join(f"func (m *M) Get{i:03}() int64 {{ return m.f{i} }}\n" for i in range(60))
HAND = "import json\n\n\ndef load(path, limit=3):\n    with open(path) as fh:\n        rows = json.load(fh)\n    out = []\n    for row in rows:\n        if row.get('size', 0) > limit:\n            out.append(row['name'].strip())\n    return sorted(out)\n\n\nclass Budget:\n    def __init__(self, size):\n        self.size = size  # rounds half up\n\n    def merge(self, other):\n        return Budget(self.size + other.size * 2)\n"
MINIFIED = "".join(f"function a{i}(b,c){{return b+c*{i}}}var d{i}={{k:{i},f:function(){{return d{i}.k?1:null}}}};" for i in range(40))
BLOB = "module.exports = [\n" + ",\n".join(", ".join(str((i * 97 + j * 31) % 256) for j in range(16)) for i in range(20)) + "\n];\n"
NOTICE = "/*! lodestar v1.11.1\n * (c) 2017 the lodestar contributors\n * Released under the MIT license\n */\n"


def expand(seqs):
    ids: dict = {}
    arrays = [np.array([ids.setdefault(t, len(ids)) for t in s], np.int64) for s in seqs]
    return Grammars(arrays, np.arange(1, len(ids) + 1, dtype=np.uint64) * np.uint64(2654435761))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="abc", max_size=60), min_size=1, max_size=6))
def test_grammars_are_sound(texts):
    g = expand(texts)
    assert g.sizes.tolist() == [len(t) for t in texts]
    assert (g.left <= g.sizes).all() and (g.covered <= g.sizes).all() and (g.rule_length >= 2).all()
    for i, a in enumerate(texts):
        for j, b in enumerate(texts):
            if len(a) > 1 and a == b:
                assert g.root[i] == g.root[j]


def test_repetition_becomes_rules():
    g = expand(["ab" * 64, "abcdefghijklmnop"])
    assert g.left[0] <= 2 and g.rule_length.max() >= 32 and g.left[1] == 16 and g.rules[1] == 0


def reasons(spark, rows):
    df = spark.createDataFrame(rows, "file_id long, repo string, file_path string, content string")
    return {r["file_key"]: r["reason"] for r in pv.classify(df).collect()}


def test_reasons(spark):
    rows = [
        (1, "a", "x/m.go", PROTO), (2, "a", "x/h.py", HAND), (3, "a", "x/m.js", MINIFIED), (4, "a", "x/b.js", BLOB), (5, "a", "x/l.js", NOTICE + "const a = 1;\n"), (6, "a", "vendor/lib/h.py", HAND), (7, "a", "vendors/h.py", HAND + "x = 1\n"),
        (8, "a", "package-lock.json", "{}"), (9, "a", "x/g.py", "# Code generated by tool v1. DO NOT EDIT.\nx = 1\n"), (10, "a", "x/w.py", 'BANNER = "Code generated by tool. DO NOT EDIT."\n# this module writes generated files; the output says do not edit\nprint(BANNER)\n'),
        (11, "a", "x/n.py", None), (12, "a", "x/e.py", ""), (13, None, None, "x = 1"), (2, "a", "x/h.py", HAND), (14, "a", "x/c.yml", "a: 1\n" * 50), (15, "a", "x/k.js", "/*! Kestrel web kit, hand-kept. (c) 2025 us */\nconst wide = /^(?:a|b)/;\n"),
    ]
    got = reasons(spark, rows)
    assert got == {1: "generated", 2: None, 3: "minified", 4: "data", 5: "vendored", 6: "vendored", 7: None, 8: "lock file", 9: "generated", 10: None, 11: None, 12: None, 13: None, 14: None, 15: None}


def test_copies_over_repositories(spark):
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdefghijkl") for _ in range(6))
    big = "".join(r.choice(("{} = {}({})\n", "if {} < {}:\n    {}()\n", "for {} in {}:\n    print({})\n", "{}[{}] += {}\n")).format(word(), word(), word()) for _ in range(90))
    twice = big + big  # what repeats inside the file is what rules can be made of
    got = reasons(spark, [(i, f"r{i}", f"src/u{i}.py", twice) for i in range(4)] + [(9, "r9", "src/v.py", HAND)])
    assert [got[i] for i in range(4)] == ["copied"] * 4 and got[9] is None


def written_by_hand(seed, lines):
    """Nothing in it repeats."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghijkl") for _ in range(6))
    return "".join(f"{word()} = {word()}({word()}, {word()}.{word()})\n" for _ in range(lines))


def test_copies_that_repeat_nothing_inside(spark):
    lib, small = written_by_hand(3, 60), written_by_hand(4, 8)
    edited = lib.splitlines(keepends=True)
    edited[30] = "changed = here(1)\n"
    licence = "".join(f"# {w}\n" for w in written_by_hand(5, 30).split("\n"))
    rows = [
        (1, "a", "src/l.py", lib), (2, "b", "app/l.py", "".join(edited)), (3, "a", "src/s.py", small), (4, "b", "app/s.py", small),
        (5, "a", "src/h.py", licence + written_by_hand(6, 9)), (6, "b", "app/h.py", licence + written_by_hand(7, 9)),  # share the licence alone
        (7, "c", "src/m.py", written_by_hand(8, 60)), (8, "c", "app/m.py", written_by_hand(8, 60)),  # in one repository
        (9, "d", "src/t.py", "x = 1\n"), (10, "e", "src/t.py", "x = 1\n"), (11, "f", "src/p.py", written_by_hand(9, 60) + small), (2, "b", "app/l.py", "".join(edited)),
    ]
    got = reasons(spark, rows)
    assert [i for i in sorted(got) if got[i] == "copied"] == [1, 2, 3, 4] and set(got.values()) == {"copied", None}


def test_empty(spark):
    assert reasons(spark, []) == {}


def test_grammars_do_not_depend_on_the_batch():
    import random

    import numpy as np

    from lexisift.llm.grammar import Grammars

    r = random.Random(4)
    words = [r.getrandbits(63) for _ in range(30)]
    files = []
    for _ in range(24):
        unit = [r.randrange(30) for _ in range(r.randrange(2, 9))]
        files.append(np.array((unit * r.randrange(1, 9) + [r.randrange(30) for _ in range(r.randrange(20))]) * r.randrange(1, 3), np.int64))

    def described(batch):
        """Per file its root, the size of its start rule and its rules; ids are handed out anew."""
        ids = {}
        seqs = [np.array([ids.setdefault(int(t), len(ids)) for t in files[k]], np.int64) for k in batch]
        g = Grammars(seqs, np.array([words[t] for t in ids], np.uint64))
        own = lambda j: sorted(zip(g.rule_hash[g.rule_file == j].tolist(), g.rule_length[g.rule_file == j].tolist(), g.rule_uses[g.rule_file == j].tolist()))
        return {k: (int(g.root[j]), int(g.left[j]), own(j)) for j, k in enumerate(batch)}

    alone = described(range(len(files)))
    for _ in range(6):
        order = list(range(len(files)))
        r.shuffle(order)
        for part in (order[:7], order[7:9], order[9:]):
            assert all(v == alone[k] for k, v in described(part).items())


def test_equal_expansions_have_equal_hashes():
    import numpy as np

    from lexisift.llm.grammar import Grammars

    words = np.random.default_rng(1).integers(1, 2**62, 8).astype(np.uint64)
    # the same phrase inside two files that pair it otherwise
    a = np.array([0, 1, 2, 3] * 6 + [2, 3] * 9, np.int64)
    b = np.array([0, 1, 2, 3] * 6 + [1, 2] * 9 + [4], np.int64)
    g = Grammars([a, b], words)
    of = [{(h, n) for h, n, f in zip(g.rule_hash, g.rule_length, g.rule_file) if f == k and n == 4} for k in (0, 1)]
    assert of[0] & of[1]
