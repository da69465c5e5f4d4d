"""All parts from files to files on a planted genome, the files between them, and the two-state cuts."""

from __future__ import annotations

import gzip
from pathlib import Path

import numpy as np
import pytest

from bintangle.operators import graph
from bintangle.plans.config import Config
from bintangle.plans.run import path_of, run
from bintangle.sources import text
from tests.test_operators import planted

TURN = str.maketrans("ACGTN", "TGCAN")


def lines_of(path):
    return [x for f in sorted(Path(path).glob("part-*")) for x in f.read_text().splitlines()]


def grouped(lines):
    out = []
    for x in lines:
        if x.startswith("#"):
            out.append([])
        else:
            out[-1].append(x.split("\t"))
    return out


@pytest.fixture(scope="module")
def genome(tmp_path_factory):
    folder = tmp_path_factory.mktemp("genome")
    rows, m, true = planted()
    rng = np.random.default_rng(1)
    names = sorted({r[2] for r in rows})
    seqs = {n: "".join(rng.choice(list("ACGT"), 50 + 10 * k)) for k, n in enumerate(names)} | {"alone": "ACGTN" * 13, "empty": ""}
    (folder / "bins.bed").write_text("".join(f"{s}\t{a}\t{b}\t{i}\r\n" for _, i, s, a, b, _, _ in rows))
    (folder / "biases").write_text("".join("1.0\n" for _ in rows[:-1]))  # the last line is missing
    cells = [(i + 1, j + 1, m[i, j]) for i in range(len(m)) for j in range(i, len(m))]
    (folder / "matrix").write_text("1\t2\t77777.0\n2\t1\t0.5\n1\t999\t5.0\n" + "".join(f"{i}\t{j}\t{float(v)!r}\n" for i, j, v in cells))
    (folder / "sizes").write_text("".join(f"{n}\t{len(s)}\n" for n, s in seqs.items()) + "s00\t50\n")
    (folder / "sites.bed").write_text("".join(f"{n}\t0\t{p}\n" for n in names for p in (3, 30, 45)))
    (folder / "pairs").write_text("".join(f"r{k}\t{a}\t5\t+\t{b}\t20\t-\n" for k, (a, b) in enumerate(zip(names, names[1:]))))
    with gzip.open(folder / "in.fa.gz", "wt") as f:
        f.write("".join(f">{n}\n" + "".join(s[k : k + 7] + "\n" for k in range(0, len(s), 7)) for n, s in seqs.items()))
    at = lambda n: str(folder / n)
    config = Config(resolution=10, modularity=1.0, restarts=3, first_scaffolds=4, scan_scaffolds=3, bed_file=at("bins.bed"), bias_file=at("biases"), matrix_file=at("matrix"), sizes_file=at("sizes"), sites_file=at("sites.bed"), pairs_file=at("pairs"), fasta_file=at("in.fa.gz"), save_directory=at("out"))
    return config, rows, true, seqs


def test_from_files_to_files(spark, genome):
    config, rows, true, seqs = genome
    run(spark, config, (1, 2))
    run(spark, config, (3, 4))  # the parts before are read from their files
    place = {r[1]: int(p) for r, p in zip(rows, true, strict=True)}
    name = {r[1]: r[2] for r in rows}
    leaves = lines_of(path_of(config, "leaves"))
    assert sorted(int(x.split("\t")[1]) for x in leaves) == list(range(60)) and all(x.split("\t")[0] == f"{name[int(x.split(chr(9))[1]) + 1]}_{int(x.split(chr(9))[1]) + 1}" for x in leaves)
    back = text.read_leaves(text.numbered_lines(spark, path_of(config, "leaves"))).orderBy("pos").collect()
    assert [f"{r.label}\t{r.at}" for r in back] == leaves
    bin_groups, groups = grouped(lines_of(path_of(config, "bin_groups"))), grouped(lines_of(path_of(config, "groups")))
    assert len(bin_groups) == len(groups) == 3 and all(len(g) == 20 and {place[int(b[0])] // 20 for b in g} == {place[int(g[0][0])] // 20} for g in [*bin_groups, *groups])
    assert {len(b) for g in bin_groups for b in g} == {5} and [b[0] for g in groups for b in g] == [b for g in groups for b in sorted((x[0] for x in g), key=int)]
    bp = [sum(len(seqs[s]) if s != "s00" else 50 for s in {b[1] for b in g}) for g in groups]
    assert bp == sorted(bp, reverse=True)
    report = lines_of(path_of(config, "assessment"))
    assert sum(x.endswith("\t5\t5\t100.00%") for x in report) == 12 and report[-5:] == ["Total nodes 60", "Properly clustered nodes 60", "Falsely clustered nodes 0", "Scaffolds assigned 12", "Error rate 0.00%"]
    assert {r.bin_id for r in text.valid_bins(text.numbered_lines(spark, path_of(config, "groups"))).collect()} == set(range(1, 61))
    ordered = grouped(lines_of(path_of(config, "order")))
    places = {}
    for i, s in name.items():
        places.setdefault(s, []).append(place[i])
    for g in ordered:
        steps = np.diff([p for s, sign in g for p in (places[s][::-1] if sign == "-" else places[s])])
        assert len(g) == 4 and ((steps == 1).all() or (steps == -1).all())
    plot = [x.split("\t") for x in lines_of(path_of(config, "plot"))[1:]]
    assert [int(b) for _, b in plot] == [b for g in ordered for s, sign in g for b in ([i for i in name if name[i] == s][:: -1 if sign == "-" else 1])]
    final = grouped(lines_of(path_of(config, "final")))
    assert final == ordered  # no scaffold is a small one
    whole, at = {}, None
    for x in lines_of(path_of(config, "fasta")):
        if x.startswith(">"):
            at = x[1:]
            whole[at] = ""
        else:
            assert len(x) <= 50
            whole[at] += x
    joined = {f"Chr_{k}": ("N" * 100).join(seqs[s] if sign == "+" else seqs[s].translate(TURN)[::-1] for s, sign in g) for k, g in enumerate(final, 1)}
    assert whole == {**joined, "alone": seqs["alone"]} and list(whole) == [*joined, "alone"]


def test_missing_settings_are_an_error(spark, tmp_path):
    with pytest.raises(ValueError, match="bed_file.*save_directory"):
        run(spark, Config(resolution=5), (1,))


def test_sections_of_one_file_over_many_ranges(spark):
    rows = [(k, "### x ###" if k % 7 == 1 else f"{k}\ts{k}") for k in range(1, 300)]
    got = {r.line_no: r.section for r in text.sections(spark.createDataFrame(rows, "line_no long, line string").repartition(5)).collect()}
    assert got == {k: (k - 1) // 7 + 1 for k, x in rows if not x.startswith("#")}
    assert text.sections(spark.createDataFrame([], "line_no long, line string")).count() == 0


def blocks(sizes, seed=0):
    rng = np.random.default_rng(seed)
    label = np.repeat(np.arange(len(sizes)), sizes)
    m = np.where(label[:, None] == label[None], 3.0, 0.1) + 0.2 * rng.random((len(label),) * 2)
    return (m + m.T) / 2


def test_two_state_cuts_of_planted_blocks():
    m = blocks([30, 25, 40, 20])
    cuts = graph.repeated_cuts(m, 5, 8, 0.2, 0.05)
    assert cuts[:3] == [30, 55, 95] and all(0 < c < len(m) for c in cuts) and cuts == sorted(cuts)
    assert graph.repeated_cuts(m, 5, 8, 0.4, 1.0) == [] and graph.repeated_cuts(np.zeros((0, 0)), 5, 8, None, 0.05) == []


def test_a_last_cut_at_the_end_is_dropped_and_the_rest_cut_again(monkeypatch):
    asked, answers = [], iter([40, 100, 60, None])

    def next_cut(m, last, width, rounds, look_ahead):
        asked.append((last, width, rounds, look_ahead))
        return next(answers)

    monkeypatch.setattr(graph, "_next_cut", next_cut)
    assert graph.repeated_cuts(np.zeros((100, 100)), 7, 4, 0.2, 0.05) == [40, 60]
    assert asked == [(0, 7, 4, 0.2), (40, 7, 4, 0.2), (40, 5, 3, 0.5), (60, 5, 3, 0.5)]
