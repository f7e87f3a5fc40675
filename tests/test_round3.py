"""What the findings of the third round were about."""

import duckdb

import __spark_entry__ as entry
from sentriflow.config import DEFAULTS
from sentriflow.operators import alerts, baselines
from sentriflow.streaming import keyed


def test_scores_that_are_a_half_round_alike(spark, tmp_path):
    """Six copies each of two connections, one of whose confidences is 0.48866796875: the order of its sums decides whether it is just below."""
    two = "(VALUES (18040, TIMESTAMP '2024-01-06 10:33:28.162433', 69.41), (18508, TIMESTAMP '2024-01-06 13:50:07.788502', 101.18)) t(n, ts, value)"
    columns = "n + i * 100000 AS event_id, ts, 1357::BIGINT AS user_id, 'click' AS event_type, value::DOUBLE AS value, '{\"k\": 7}' AS props"
    con = duckdb.connect()
    con.execute(f"COPY (SELECT {columns} FROM {two}, range(6) r(i)) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    for name, shown in (("det_c2", ["id", "score", "confidence"]), ("det_c2_behaviour", ["id", "score"])):
        got = sorted(map(tuple, entry.queries()[name](spark, str(tmp_path)).select(*shown).collect()))
        assert got == sorted(con.execute(f"SELECT {', '.join(shown)} FROM ({entry.oracle_sql()[name]})").fetchall())


def test_an_alert_is_scored_against_few_of_many_open_incidents(monkeypatch):
    """2,000 sources talk to one destination within minutes: each is an incident of its own, and an alert looks at one incident for each set of threats."""
    scored, plain = [], alerts._Fold._score
    monkeypatch.setattr(alerts._Fold, "_score", lambda self, *row: scored.append(row) or plain(self, *row))
    fold = alerts._Fold(dict(DEFAULTS["correlation"]))
    kinds = ("Reconnaissance", "C2_Beacon", "DDoS")
    found = [fold.take(kinds[i % 3], f"s{i}", "d", 0.1 * i) for i in range(2000)]
    assert [n for n, _ in found] == list(range(1, 2001)) and len(scored) <= 3 * 2000


class _Cell:
    """A state of a key in memory, which counts the calls."""

    def __init__(self):
        self.rows, self.calls = [], 0

    def _say(self, rows):
        self.calls, self.rows = self.calls + 1, rows

    def get(self):
        self.calls += 1
        return iter(self.rows)

    def appendList(self, rows):  # noqa: N802  as Spark's states have it
        self._say([*self.rows, *rows])


class _Value(_Cell):
    def exists(self):
        return bool(self.rows)

    def get(self):
        return self.rows[0]

    def update(self, row):
        self._say([row])


def test_a_baseline_alone_has_one_key_and_few_calls_for_its_state():
    """500 rows to 40 destinations in two parts: destinations are read and written once for each part, and the second knows those of the first."""
    state = keyed.Histories(DEFAULTS, ("baseline",))
    assert state.kinds == ["source"] and list(state.columns()) == list(baselines.HOST)
    state.host, state.known = _Value(), _Cell()
    row = lambda i: (f"f{i}", "s", f"d{i % 40}", None, 1.0, 1.0, 1.0, float(i), i)
    novel = [x for part in (range(250), range(250, 500)) for x in state._source([], [row(i) for i in part])["is_destination_novel"]]
    assert novel == [i < 40 for i in range(500)] and state.known.calls <= 3 and len(state.known.rows) == 40
