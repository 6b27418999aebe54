"""The search for a tag against the whole parser."""

import gzip
import random

import pytest

from braggframe.sources import cif, cif_search


def made(rng):
    value = lambda: rng.choice(["1", "a_b", "'two words'", '"it\'s"', ".", "?", "x#y", "'a'b'", "loop", "-1.5(2)", "\n;text\n_other 1\nloop_\n;\n", "data", "'_tag'", '"loop_"'])
    out = []
    for b in range(rng.randint(1, 3)):
        out.append(f"data_b{b}\n")
        for _ in range(rng.randint(0, 5)):
            kind = rng.random()
            if kind < 0.4:
                out.append(f"{rng.choice(['_a.x', '_A.X', '_b', '_c'])} {value()}{rng.choice([chr(10), ' ', ' # note' + chr(10)])}")
            elif kind < 0.9:
                tags = rng.sample(["_a.x", "_a.y", "_B", "_d"], rng.randint(1, 4))
                rows = rng.randint(1, 4)
                sep = rng.choice([" ", "\n"])
                out.append("loop_" + sep + sep.join(tags) + "\n" + "".join("".join(value() + rng.choice([" ", " ", "\n"]) for _ in tags) + rng.choice(["\n", " ", "\n# c\n"]) for _ in range(rows)) + "\n")
            else:
                out.append(rng.choice(["# only a note\n", "save_f\n", "save_\n", "\n"]))
    return "".join(out)


def test_search_equals_the_parser():
    rng = random.Random(1)
    n = 0
    for _ in range(3000):
        text = made(rng)
        for tag in ("_a.x", "_b"):
            try:
                want = [(r[0], r[1], r[2], r[6], r[7], r[9].replace("\r", "")) for r in cif.parse_cif(text) if r[6] and r[6].lower() == tag and r[9] is not None]
            except cif.CifError:
                with pytest.raises(cif.CifError):
                    list(cif_search.found_values(iter(text.splitlines(True)), tag))
                continue
            got = list(cif_search.found_values(iter(text.splitlines(True)), tag))
            assert [r[:6] for r in got] == want, text
            n += len(want)
    assert n > 2000


def test_search_of_files(spark, tmp_path):
    with gzip.open(tmp_path / "a.cif.gz", "wt") as f:
        f.write("data_a\nloop_\n_x.id\n_x.v\n" + "".join(f"{i} v{i}\n" for i in range(50_000)))
    (tmp_path / "b.cif").write_text("data_b\n_x.v 'one'\n")
    (tmp_path / "c.cif").write_text("data_c\n_x.v\n")
    got = cif_search.search_tag(spark, str(tmp_path), "_X.v")
    assert got.where("_parse_error is null").groupBy("block").count().orderBy("block").collect() == [("a", 50_000), ("b", 1)]
    assert got.where("_parse_error is not null").count() == 1
    assert cif_search.search_tag(spark, str(tmp_path), "_x.v", first_only=True).where("block is not null").count() == 2
