from __future__ import annotations

from docloom.operators import compaction as C
from docloom.operators import indexes as X
from docloom.plans import query as Q
from docloom.stats import QueryStats, QueryTimer, pattern_of


def segment(name, low, high, size=900, seq=0):
    return C.Segment(name, low, high, size, 0, seq)


def test_levels_and_thresholds():
    assert [C.UnifiedPolicy(0, 1000).level(n) for n in (500, 1000, 1999, 2000, 4000, 8000)] == [0, 0, 0, 1, 2, 3]
    assert [C.UnifiedPolicy(w).threshold for w in (-8, 0, 1, 8)] == [2, 2, 3, 10]
    assert [C.UnifiedPolicy(w).fanout for w in (-8, 0, 8)] == [10, 2, 10]


def test_picks_hang_together():
    a, b, c, d = segment("a", "0", "3"), segment("b", "3", "5"), segment("c", "6", "7"), segment("d", "65", "9")
    picks = C.UnifiedPolicy(0, 1000).pick_all([d, b, c, a])
    assert [[s.name for s in p.segments] for p in picks] == [["a", "b"], ["c", "d"]] and picks[0].level == 1
    assert C.UnifiedPolicy(4, 1000).pick([a, b, c, d]) is None
    assert C.UnifiedPolicy(0, 1000).pick([a, c]) is None


def test_scaling_follows_the_reads():
    now = [0.0]
    a = C.AdaptiveScaling(clock=lambda: now[0], cooldown_seconds=60, step=4)
    a.read(5)
    assert a.adjust() == 0  # too few, but they count on
    a.read(5)
    assert a.adjust() == -4 and a.target == -8
    a.read(100)
    assert a.adjust() == -4  # too soon
    now[0] = 61
    assert a.adjust() == -8
    now[0] = 200
    a.write(10)
    assert a.adjust() == -4 and a.target == 8


def test_rebuild_rules():
    assert [X.rebuild_pays(m, n) for m, n in ((3000, 1000), (4000, 1000), (1, 0), (200, 100), (250, 100))] == [False, True, True, False, True]
    assert X.widen_pays(50, 100) and not X.widen_pays(49, 100)
    i = X.Index("x", ["a"], None, [], 0, 10, 0.0)
    assert i.to_drop(720 * 3600) and not i.to_drop(719 * 3600)
    i.used(1.0)
    assert not i.to_drop(1e9)


def test_filters_survive_the_catalog():
    f = Q.Or(Q.Not(Q.Range("a", 1, 2.5)), Q.And(Q.Eq("b", "x"), Q.Exists("c")), Q.Gt("d", b"\x01"))
    assert X.dump_filter(X.load_filter(X.dump_filter(f))) == X.dump_filter(f)
    both = [X.Index("x", ["a"], X.dump_filter(Q.Lt("a", 1)), []), X.Index("y", ["a"], None, [])]
    assert X.merged_predicate(both) is None


def test_stats():
    ticks = iter((1.0, 3.0))
    stats = QueryStats()
    q = Q.Scan(Q.And(Q.Gt("b", 1), Q.Eq("a", 2), Q.Lt("b", 9)), sort=(Q.SortField("c"),))
    QueryTimer(stats, pattern_of(q), lambda: next(ticks)).done(10, 1)
    (pattern, s), = stats.all()
    assert pattern.filter_fields == ("a", "b") and s.average_seconds == 2.0 and stats.low_selectivity(0.5, 1) and not stats.low_selectivity(0.05, 1)
    assert stats.get(pattern_of(Q.Get("x"))) is None
    stats.reset()
    assert stats.all() == []
