import itertools
import random

from presswork.llm import names as N

S = "entity_surface string, raw_label string, n long, root string, tokens string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", "y") for r in rows], S)


ENTITIES = [
    ("company", ["Tolnitmir Technologies", "TOLNITMIR", "Tolnitmir Technologise", "The Tolnitmir Technologies Ltd", "TolnitmirTechnologies", "Tolnitmir Tech", "Technologies Tolnitmir", "TLNTM", "tolnitmir_technologies"]),
    ("company", ["Haktesfom Holdings", "HAKTESFOM Hldgs", "Haktesfom-Holdings", "Haktesfom Holdings, Inc", "Haktsefom Holdings"]),
    ("org", ["Haktesfom Semiconductor", "Haktesfom Semi", "Haktesfom Semiconductor GmbH"]),
    ("person", ["Margaret Femburgat", "Dr. Margaret Femburgat", "Femburgat, Margaret", "M. Femburgat", "Peggy Femburgat", "Margaret K. Femburgat", "MARGARET FEMBURGAT", "Margaret Fembrgat"]),
    ("person", ["Robert Mitmuldor", "Bob Mitmuldor", "Mitmuldor Robert"]),
    ("PER", ["William Mitmuldor", "Mitmuldor, William", "William E. Mitmuldor"]),
    ("technology", ["Hodnartun Studio", "Studio by Hodnartun", "Hodnartun Studio™", "hodnartun", "Hodnartun's Studio"]),
    ("government institution", ["Ministry of Digital Affairs of Fotmekput", "Fotmekput Min. of Digital Affairs", "Ministry of Digital Affairs (Fotmekput)", "Fotmekput's Ministry of Digital Affairs"]),
    ("government institution", ["Data Protection Authority of Kalbolkom", "DPA of Kalbolkom"]),
    ("company", ["Femburgat Robotics", "FEMBURGAT Rob."]),
]
LONE = [("company", "Mitmuldor Systems"), ("product", "Nidlotdom Agent"), ("person", "Mitmuldor"), ("other", "they"), ("other", "2024"), ("other", "$4,500"), ("company", "AI"), ("company", "Haktesfom"), (None, "Tolnitmir Technologies Inc")]
EXTRA = [("person", f"{f} {s}") for f in ("Robert", "William", "Margaret", "Anke", "Olga", "Piotr") for s in ("Lordosnil", "Geddukkad", "Vekpemnod", "Pindimrus")]
EXTRA += [("company", f"{r} {d}") for r in ("Sumkorgun", "Boktorver", "Litkumtik", "Nanbimnis") for d in ("Technologies", "Holdings", "Robotics", "Systems", "Semiconductor")]
EXTRA += [("technology", f"{r} {d}") for r in ("Rethirdad", "Bumkellan", "Kodranfad", "Deknidpod") for d in ("Studio", "Agent")]
EXTRA += [("government institution", f"{d} of {r}") for r in ("Vimdoddit", "Gatlelped", "Sasgulden", "Rulgelbed") for d in ("Ministry of Digital Affairs", "Data Protection Authority")]


def all_rows():
    rows = [(n, lab) for lab, ns in ENTITIES for n in ns] + [(n, lab) for lab, n in [*LONE, *EXTRA]]
    return [*rows, *rows[:20], (None, "company"), ("", "company")]


def test_variants_are_linked_and_nothing_else(spark):
    got = {tuple(r) for r in N.name_pairs(N.name_groups(frame(spark, all_rows()))).collect()}
    want = {tuple(sorted(p)) for _, ns in ENTITIES for p in itertools.combinations(ns, 2)}
    assert got - want == set() and want - got == set()


def test_delete_index_against_all_pairs(spark):
    r = random.Random(1)
    base = ["".join(r.choice("bdfgklmnprstv") + r.choice("aeiou") + r.choice("bdfgklmnprstv") for _ in range(3)) for _ in range(60)]
    words = set(base)
    for w in base:
        k = r.randrange(1, 7)
        words.add(r.choice([w[:k] + w[k + 1:], w[:k] + "q" + w[k:], w[:k] + w[k + 1] + w[k] + w[k + 2:], w[:k] + "q" + w[k + 1:]]))
    rows = [(w, "company") for w in words] + [(b, "company") for b in base for _ in range(3)]
    named = N._tokenised(N._spellings(frame(spark, rows)))
    got = {x["token"]: x["canon"] for x in N.token_canon(named).collect()}
    count = {w: 3 * (w in base) + 1 for w in words}
    for w in words:
        near = [v for v in words if v != w and N.one_edit(v, w) and (count[v], v) > (count[w], w)]
        assert got[w] == (max(near, key=lambda v: (count[v], v)) if near else w)


def test_alignment_rules():
    no = lambda x, y: False
    assert N.align(("liela",), ("leila",), no) == "same"
    assert N.align(("a",), ("anke",), no) == "abbr"
    assert N.align(("peggy",), ("margaret",), no) == "same"
    assert N.align(("margaret", "k"), ("margaret",), no) == "same"
    assert N.align(("dpa",), ("data", "protection", "authority"), no) == "abbr"
    assert N.align(("ai", "commission"), ("commission", "artificial", "intelligence"), no) == "abbr"
    assert N.align(("marta",), ("martin",), no) is None
    assert N.align(("marta",), ("maria",), lambda x, y: True) is None
    assert N.align(tuple("abcdefghi"), tuple("abcdefghj"), no) is None
    assert N.align(("claude", "2"), ("claude", "3"), no) is None and N.align(("claude", "2"), ("2", "claude"), no) == "same"
    eight = tuple("national office forxal digital health records exchange services".split())
    typo = tuple("national office forxal digitla health records exchange services".split())
    assert N.align(typo, eight, no) == "same" and N.align((*typo[:7], "svcs"), eight, no) == "abbr"
    assert N.align(tuple("nof digital health records exchange services".split()), eight, no) == "abbr"
    assert N.align(tuple("nof dhr exchange services".split()), eight, no) == "abbr"
    assert N.align(eight[::-1], eight, no) == "same" and N.align(eight[:7], eight, no) is None


def test_assignment_is_optimal():
    r = random.Random(4)
    for _ in range(60):
        n = r.randint(1, 5)
        m = [[r.choice((0, 1, 5, 100, 1e9)) for _ in range(n)] for _ in range(n)]
        assert N.assignment(m) == min(sum(m[i][p[i]] for i in range(n)) for p in itertools.permutations(range(n)))


def test_abbreviations():
    for a, b in (("hldgs", "holdings"), ("anlytcs", "analytics"), ("intl", "international"), ("sw", "software"), ("govt", "government"), ("labs", "laboratories"), ("semi", "semiconductor"), ("m", "margaret")):
        assert N.abbreviates(a, b)
        assert a[0] == b[0] and (b.startswith(a) or b.startswith(a[:-1]) or N.contraction_key(a) in N.contraction_keys(b))
    assert not N.abbreviates("smcndctr", "semi") and not N.abbreviates("3", "3m") and not N.abbreviates("hsldg", "holdings")
    assert N.contraction_keys("b" * 5000) == set() and not N.abbreviates("bbb1", "b" * 5000)


def test_blocks_with_an_index_equal_blocks_without():
    r = random.Random(8)
    no = lambda x, y: False
    full = [w for w in ("margaret martin maria marta michael mildred monica matthew mitchell morgan murdoch melinda mariano marcus meredith marvin "
                        "milton malcolm".split())] + ["".join(r.choice("mnrlteaio") for _ in range(7)) for _ in range(60)]
    tup = set()
    for w in full:
        for k in range(3):
            t = w[:r.randint(2, len(w))] if k == 0 else N.skeleton(w) if k == 1 else w[:3] + w[4:]
            tup.add(tuple(x for x in ("m" + t, r.choice(full)) if x))
        tup.add(("m" + w, r.choice(full)))
        tup.add(("m", r.choice(full)))
    own = {t: (r.random() < 0.8, tuple(x for x in t if not N.initial(x))) for t in tup}
    assert sorted(N.link_block(own, no)) == sorted(N.link_block(own, no, few=1 << 30))


def linked(spark, rows):
    return {tuple(r) for r in N.name_pairs(N.name_groups(frame(spark, rows))).collect()}


def test_numbers_short_names_and_other_scripts(spark):
    rows = [(n, "product") for n in ("Claude 2", "claude-2", "Claude 3", "Windows 10", "Windows 11", "WINDOWS 11")]
    rows += [(n, "company") for n in ("3M", "3m Inc.", "IBM", "I.B.M.", "B.M.W.", "BMW", "BMX", "AI", "ai", "2024", "$4,500")]
    rows += [(n, "person") for n in ("Li Na", "LI NA", "Na, Li", "Wu Xi", "Wu Xi.", "李娜", "李娜 ", "王伟")]
    assert linked(spark, rows) == {tuple(sorted(p)) for p in (
        ("Claude 2", "claude-2"), ("Windows 11", "WINDOWS 11"), ("3M", "3m Inc."), ("IBM", "I.B.M."), ("BMW", "B.M.W."), ("Li Na", "LI NA"),
        ("Li Na", "Na, Li"), ("LI NA", "Na, Li"), ("Wu Xi", "Wu Xi."), ("李娜", "李娜 "))}


def test_long_names(spark):
    a = "National Office of Forxal for Digital Health Records and Exchange Services"
    b = a.replace("Digital", "Digitla")
    assert linked(spark, [(a, "org"), (b, "org"), (a + " North", "org")]) == {tuple(sorted((a, b)))}


def test_groups_hold_every_pair(spark):
    g = N.name_groups(frame(spark, all_rows()))
    m = [(r["group_id"], r["entity_surface"]) for r in N.membership(g).collect()]
    by = {}
    for k, n in m:
        by.setdefault(k, []).append(n)
    pairs = {tuple(sorted(p)) for ns in by.values() for p in itertools.combinations(ns, 2)}
    assert len(m) == len(set(m)) and pairs == {tuple(r) for r in N.name_pairs(g).collect()}


def test_one_root_with_very_many_names():
    import time

    r = random.Random(2)
    first = ["".join(r.choice("bdfgklmnprstv") + r.choice("aeiou") for _ in range(4)) for _ in range(20_000)]
    blocks = {}
    for f in first:
        for t in ((f,), (f[:3] + f[4:],), (f, "k"), (f[0],)):
            for sig, own in N.signatures(list(t), list(t)):
                blocks.setdefault(sig, {})[t] = (own, tuple(x for x in t if not N.initial(x)))
    assert max(map(len, blocks.values())) < 20_000
    t = time.time()
    N.link_block(max(blocks.values(), key=len), lambda x, y: False)
    assert time.time() - t < 30


def test_empty_and_unlabelled(spark):
    assert N.name_groups(frame(spark, [("x", None)]).limit(0)).count() == 0
    assert N.name_groups(frame(spark, [(None, None), ("Some Name", None)])).count() == 0
    long = "Verylongname " * 2000
    assert N.name_groups(frame(spark, [(long, "company"), (long + "x", "company")])).select("group_id").distinct().count() in (0, 1)
