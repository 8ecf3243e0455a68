"""Scripts against what they must give: short ones here, and recorded runs in a folder that the environment names.

RECORDED_RUNS: a folder with scripts (a file without suffix or with .ops) and, anywhere
below it, the lines that each gave (.out, same stem).
"""

import os
import random
from pathlib import Path

import pytest

from ordkeys.operators.session import Session
from ordkeys.sources import files


def run(spark, place, lines):
    return Session(spark, f"file://{place}").run(lines)


def recorded():
    top = os.environ.get("RECORDED_RUNS")
    if not top:
        return []
    scripts = {p.stem: p for p in sorted(Path(top).rglob("*")) if p.is_file() and p.suffix in ("", ".ops")}
    return [(scripts[p.stem], p) for p in sorted(Path(top).rglob("*.out")) if p.stem in scripts]


def comparable(lines):
    """Result lines; of stats only what follows from the history of keys."""
    return [" ".join(["= stats", *x.split()[3:6]]) if x.startswith("= stats") else x for x in lines]


@pytest.mark.skipif(not recorded(), reason="RECORDED_RUNS names no folder with recorded runs")
@pytest.mark.parametrize("script, want", recorded(), ids=lambda p: p.stem)
def test_recorded_runs(spark, tmp_path, script, want):
    lines = script.read_text().splitlines()
    saved = {x.split()[1] for x in lines if x.startswith("save ")}
    good = files.write_automaton([False, True], [[(97, 2)], []])
    damaged = {"good": good, "trunc": good[:-7], "magic": b"X" + good[1:], "crc": good[:-1] + bytes([good[-1] ^ 1]), "empty": b""}
    for name in {x.split()[1] for x in lines if x.startswith("load ")} - saved:  # files that a script takes for given
        (tmp_path / name).write_bytes(next(data for kind, data in damaged.items() if kind in name))
    assert comparable(run(spark, tmp_path, lines)) == comparable(want.read_text().splitlines())


def test_order_statistics_below_states(spark, tmp_path):
    lines = ["create", *(f"add {k}" for k in ("61", "6162", "616263", "616264", "6163", "62", "6263", "6264", "63", "6300")), "stats"]
    want = ["= create 1", *["= add 1"] * 10, "= stats ? 5 4 8 ?"]
    ranks = {"61": 0, "6163": 4, "6164": 5, "616265": 4, "6265": 8, "00": 0, "6301": 10, "ff": 10}
    lines += [f"rank {k}" for k in ranks]
    want += [f"= rank {n}" for n in ranks.values()]
    lines += ["select 0", "select 9", "select 10", "rancount 61 62", "rancount 6163 6163", "rancount ff 00", "rank zz", "rancount 61"]
    want += ["= select 1 61", "= select 2 6300", "= select -1", "= rc 5", "= rc 0", "= rc 0", "= rank 0", "= rc 0"]
    lines += ["fromstate 61", "rank 62", "rank 64", "select 0", "select 2", "select 5", "rancount 62 64", "fromstate 7a", "select 1", "del 61", "fromstate 61", "select 0", "abi", "nonsense", "free", "rank 61"]
    want += ["= fromstate 1", "= rank 1", "= rank 5", "= select 0 ", "= select 2 6263", "= select -1", "= rc 4", "= fromstate 0", "= select 2 6162", "= del 1", "= fromstate 1", "= select 1 62", "= abi 1", "= error NOTIMPL", "= free 1", "= error NOTIMPL"]
    assert run(spark, tmp_path, lines) == want


def test_files_views_and_logs(spark, tmp_path):
    one, two, three = "6100" + "00" * 7, "01", "02"
    lines = [
        "create", f"add {one}{two}", "add 6200aa", "add 7a7a7a", "del 7a7a7a", "add 62", "save s", "stats", "load s", "stats", "lookup 7a7a7a", "lookup 62",
        "wopen w", f"wadd {one}{three}", f"wdel {one}{two}", "wadd 6262", "wadd ", "wsize", "wclose", "wopenro w", "wreplay", "wadd 61", "wclose", "wopenro none",
        "vopen s", "vrank ff", "vselect 0", "vrancount 61 6200", f"vlookup {one}{two}", "vprefix 62", "lopen s w", f"vlookup {one}{two}", f"vlookup {one}{three}", "vlookup 6262", "vprefix 61", "vrank ff", "vclose", "vlookup 61",
        "load none", "vopen none", "buildbegin", "bkey 62", "bkey 61", "bkey 61", "buildend", "select 0", "loadro s", "select 0",
    ]
    want = [
        "= create 1", "= add 1", "= add 1", "= add 1", "= del 1", "= add 1", "= save 0", "= stats ? 15 2 14 ?", "= load 1", "= stats ? 15 2 14 ?", "= lookup 0", "= lookup 1",
        "= wopen 1", "= wadd 0", "= wdel 0", "= wadd 0", "= wadd -1", f"= wsize {16 + 19 + 19 + 11}", "= wclose", "= wopenro 1", "= wreplay 3", f"1 {one}{three}", f"2 {one}{two}", "1 6262", "= wadd -1", "= wclose", "= wopenro 0",
        "= vopen 1", "= vrank 3", f"= vselect {len(one + two) // 2} {one}{two}", "= vrc 2", "= vlookup 1", "= vprefix 1", "aa", "= lopen 1", "= vlookup 0", "= vlookup 1", "= vlookup 0", "= vprefix 1", one[4:] + three, "= vrank 3", "= vclose", "= vlookup 0",
        "= load 0", "= vopen 0", "= build 1", "= select 1 61", "= loadro 1", f"= select {len(one + two) // 2} {one}{two}",
    ]
    got = run(spark, tmp_path, lines)
    states = [x for x in got if x.startswith("= stats")]
    assert states[0] == states[1]  # dead branches survive in files
    assert comparable(x for x in got if not x.startswith("= stats")) == [x for x in want if not x.startswith("= stats")]


def test_random_scripts_by_brute_force(spark, tmp_path):
    r = random.Random(5)
    key = lambda: "".join(r.choice(["61", "62", "00"]) for _ in range(r.randrange(0, 5)))
    lines, want, live = ["create"], ["= create 1"], set()
    for i in range(400):
        k = key()
        op = r.choice(["add", "add", "lookup", "del"]) if i % 100 else r.choice(["rank", "select"])
        if op == "rank":
            want.append(f"= rank {sum(x < k for x in live)}")
        elif op == "select":
            n = r.randrange(len(live) + 3)
            want.append(f"= select {len(sorted(live)[n]) // 2} {sorted(live)[n]}" if n < len(live) else "= select -1")
            k = n
        elif op == "add":
            want.append(f"= add {int(k not in live)}")
            live.add(k)
        else:
            want.append(f"= {op} {int(k in live)}")
            if op == "del":
                live.discard(k)
        lines.append(f"{op} {k}")
    assert run(spark, tmp_path, lines) == want
