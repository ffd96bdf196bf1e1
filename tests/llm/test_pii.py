import hashlib
import random
import re

import pyarrow as pa

from steadyframes.llm import pii
from steadyframes.llm.textbytes import blocks

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base(t):
    out = []
    for kind, p in PATTERNS.items():
        for m in re.finditer(p, t):
            d = re.sub(r"[^0-9]", "", m[0])
            keep = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 16 <= len(d) <= 19 and pii.luhn(d), "phone": 8 <= len(d) <= 15}
            if keep[kind]:
                out.append((kind, m.start(), m.end()))
    return out


def test_base_spans_equal_the_patterns():
    r = random.Random(1)
    for _ in range(30000):
        t = "".join(r.choice("aB1.@-+ ()0.5%_9@é") for _ in range(r.randint(0, 24)))
        assert pii.base_spans(t) == base(t), t
    for t in ("4556737586899855", "4556 7375 8689 9855 12", "00255.1.2.3", "256.1.1.1.1", "a@b.c@d.e", "+1 (212) 555-0143 x", "1" * 5000, "a" * 5000 + "@"):
        assert pii.base_spans(t) == base(t)


def test_digest_keeps_base_and_counts_all(spark):
    rows = [(1, "Mail é a.b@mail.example.org now, 10.1.2.3 or +1 (212) 555-0143."), (2, None), (3, ""), (4, "plain words only, nothing else."), (5, "x +1 (269) 555-3296 4524132264652876 and"), (1, "Mail é a.b@mail.example.org now, 10.1.2.3 or +1 (212) 555-0143.")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for r in pii.digest(df).collect():
        t = dict(rows)[r.doc_id] or ""
        want = sorted(base(t), key=lambda x: (pii.KINDS.index(x[0]), x[1]))
        said = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert set(filter(None, said.split(","))) <= set(r.spans.split(","))
        assert r.n_email + r.n_ip + r.n_card + r.n_phone == len([x for x in r.spans.split(",") if x])
        if r.doc_id == 5:  # one chain of digits to the patterns; two spans to the field
            assert r.spans == "card:20:36,phone:2:19"
        if r.doc_id in (2, 3, 4):
            assert r.spans == ""


def test_field_learns_its_table_and_leaves_prose_alone():
    f = pii.field()
    for line in pii.EXAMPLES.split("\n"):
        text = re.sub(r"\{\w+:([^}]*)\}", r"\1", line)
        marked = [m[1] for m in re.finditer(r"\{(\w+):", line)]
        for _, _, buf, offsets in blocks(pa.array([text])):
            got = [k for k, _, _ in pii.field_spans(f, buf, offsets).get(0, [])]
        assert got == marked, line
    prose = "The dot on the map is at 7. Nothing (at all) is here: 1999, v2.0, 12-14. " * 200
    for _, _, buf, offsets in blocks(pa.array([prose])):
        assert pii.field_spans(f, buf, offsets) == {}


def test_words_cut_by_pruning_are_none_for_the_whole_decoder():
    """A sequence that the bound leaves out decodes to none throughout."""
    import numpy as np

    f = pii.field()
    words = "Thonwhing re the of ering anble Einung schein ééaux".split()
    ids = [[f.edge], *[f.ids(w) for w in words], [f.edge]]
    emit = np.array([[f.weights[0][ids[t + 1]].sum(0) + f.weights[1][ids[t]].sum(0) + f.weights[2][ids[t + 2]].sum(0) for t in range(len(words))]])
    assert not pii.viterbi(emit, np.array([len(words)]), f).any()


def test_redact_and_clashing_names(spark):
    df = spark.createDataFrame([(1, "to a@b.cd, bye", "x"), (2, None, "y")], "doc_id long, text string, pii string")
    got = pii.redact(df)
    assert got.columns == df.columns
    assert sorted(map(tuple, got.collect())) == [(1, "to [EMAIL], bye", "x"), (2, None, "y")]
    assert pii.digest(df.where("false")).count() == 0


def test_long_words_have_scores_of_their_own_in_any_order():
    import numpy as np

    from steadyframes.llm import pii

    f = pii.field()
    words = ["https://example.org/" + "path/" * 20, "a" * 70 + "@host", "x" * 300 + "@mail.example.org", "(" * 80 + "AbC", "..........(at).........."]
    for order in (words, words[::-1]):
        f.known.clear()
        for w in order:
            assert (f.scores(w) == np.stack([f.weights[side][f.ids(w)].sum(0) for side in range(3)])).all(), w


def test_counts_are_of_base_spans(spark):
    """The contract fixes the counts as it does base_sha256; what the field adds shows in spans alone."""
    rows = [(1, "x +1 (269) 555-3296 4524132264652876 and"), (2, "card 2353820953013749 4550997810720808 , 10.1.2.3 and a.b@mail.example.org"), (3, None), (4, "(415) 555-2671 8.8.8.8.8 +44 20 7946 0018")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    added = 0
    for r in pii.digest(df).collect():
        want = base(dict(rows)[r.doc_id] or "")
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for k, _, _ in want) for kind in pii.KINDS], r.doc_id
        added += len([x for x in r.spans.split(",") if x]) - len(want)
    assert added >= 3
