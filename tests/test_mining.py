"""The mining loop: a run that is stopped after any step goes on where it was."""

import random

import pytest

from factorloom.operators.library import Candidate
from factorloom.operators.mining import STEPS, ListProvider, MiningLoop, panel_scorer, plain

OFFERS = [
    Candidate("a", "$close", "level"), Candidate("b", "$close +", "broken"), Candidate("c", "$volume"), Candidate("d", " $close "),
    Candidate("e", "Sub($close, $volume)"), Candidate("f", "Frob($close, 2)"), Candidate("g", "$bogus"), Candidate("h", "Abs($volume)"),
    Candidate("i", "Mul($close, 2)"), Candidate("j", "$volume"), Candidate("k", "Log($close)"),
]


class Stop(Exception):
    pass


@pytest.fixture(scope="module")
def panel(spark):
    rng = random.Random(1)
    rows = [(d, a, c := rng.uniform(1, 9), rng.uniform(-1, 1), c + rng.gauss(0, 0.3)) for d in range(4) for a in range(15)]
    return spark.createDataFrame(rows, "date int, asset int, close double, volume double, ret double").cache()


def loop(spark, panel, path, provider):
    return MiningLoop(spark, str(path), provider, panel_scorer(panel, "ret", min_ic=0.5))


def kept(df):
    return sorted((r["round"], r["name"], r["expression"]) for r in df.collect())


def test_stopped_after_any_step(spark, panel, tmp_path, monkeypatch):
    straight = ListProvider(OFFERS, 4)
    want = kept(loop(spark, panel, tmp_path / "one", straight).run(3))
    assert [w[1] for w in want if w[1] in "aeik"] and "a" in [w[1] for w in want] and not {"b", "d", "f", "g", "j"} & {w[1] for w in want}

    provider, real, stops = ListProvider(OFFERS, 4), MiningLoop._write, []

    def write(self, number, step, payload):
        done = real(self, number, step, payload)
        if (number, step) not in stops:
            stops.append((number, step))
            raise Stop
        return done

    monkeypatch.setattr(MiningLoop, "_write", write)
    for _ in range(3 * len(STEPS)):
        with pytest.raises(Stop):
            loop(spark, panel, tmp_path / "two", provider).run(3)
    got = loop(spark, panel, tmp_path / "two", provider).run(3)
    assert kept(got) == want and stops == [(n, s) for n in (1, 2, 3) for s in STEPS]
    assert provider.told == straight.told and len(provider.told) == 3
    assert "best: " in provider.told[1] and "rejected: " in provider.told[1] and provider.told[0] == ""


def test_stopped_in_the_middle_of_storing(spark, panel, tmp_path, monkeypatch):
    provider, real, calls = ListProvider(OFFERS, 4), MiningLoop._store, []

    def store(self, number, scored):
        out = real(self, number, scored)
        calls.append(number)
        if len(calls) == 1:
            raise Stop  # the library is written, the step isn't
        return out

    monkeypatch.setattr(MiningLoop, "_store", store)
    with pytest.raises(Stop):
        loop(spark, panel, tmp_path, provider).run(1)
    again = loop(spark, panel, tmp_path, provider)
    rows = again.run(1).collect()
    assert calls == [1, 1] and len(again.library.versions()) == 1 and len(rows) == len({r["key"] for r in rows})
    assert again.known() == {plain(r["expression"]) for r in rows}


def test_nothing_is_proposed(spark, panel, tmp_path):
    empty = loop(spark, panel, tmp_path, ListProvider([], 3))
    assert empty.run(2).count() == 0 and [r.step for r in empty._rounds()] == [*STEPS, *STEPS]
