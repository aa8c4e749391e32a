from datetime import datetime, timedelta

import pytest
from models import burst_model, random_logs, repeat_model

from emberlog.operators import patterns

START = datetime(2024, 1, 1)


def after(*seconds):
    return [(i, "a", "same text", "ERROR", START + timedelta(seconds=s)) for i, s in enumerate(seconds)]


def burst_ids(frame):
    return sorted(r.id for r in frame.select("id").collect())


@pytest.mark.parametrize("seed,threshold,window,cooldown,scope", [
    (1, 3, 10, 60, "source"), (2, 3, 10, 60, None), (3, 10, 30, 0, None), (4, 2, 1, 5, "source"), (5, 50, 300, 100, None)])
def test_bursts_match_the_model(logs, seed, threshold, window, cooldown, scope):
    rows = random_logs(seed)
    found = patterns.error_burst(logs(*rows), threshold, window, cooldown, scope)
    expected = burst_model(rows, threshold, window, cooldown, scope)
    assert burst_ids(found) == expected and expected


def test_burst_window_is_inclusive(logs):
    assert burst_ids(patterns.error_burst(logs(*after(0, 30, 60)), 3, 60, 300)) == [2]
    assert burst_ids(patterns.error_burst(logs(*after(0, 30, 60.000001)), 3, 60, 300)) == []


def test_burst_cooldown_is_strict(logs):
    def second(at):
        return burst_ids(patterns.error_burst(logs(*after(0, 10, at - 10, at)), 2, 60, 300))
    assert second(310) == [1]
    assert second(310.000001) == [1, 3]


def test_burst_needs_two(logs):
    with pytest.raises(ValueError):
        patterns.error_burst(logs(*after(0)), threshold=1)


def test_burst_alert_text(logs):
    alert = patterns.burst_alerts(patterns.error_burst(logs(*after(0, 1)), 2, 60, 300), 2, 60).first()
    assert alert.message == "2 ERROR logs within 60 seconds. Latest error: a - same text"
    assert (alert.kind, alert.alert_ts) == ("error-burst", START + timedelta(seconds=1))


@pytest.mark.parametrize("seed,threshold,window", [(1, 3, 20), (2, 3, 300), (3, 20, 60), (4, 2, 0)])
def test_repeats_match_the_model(logs, seed, threshold, window):
    rows = random_logs(seed)
    expected = repeat_model(rows, threshold, window)
    found = {r.trigger_log.id: (r.additional_data.repeat_count, [x.id for x in r.related_logs])
             for r in patterns.repeated_error(logs(*rows), threshold, window).collect()}
    assert found == expected and expected


def test_equal_times_count_in_id_order(logs):
    rows = after(5, 5, 5)
    found = {r.id: r.repeat_count for r in patterns.repeated_error_candidates(logs(*rows), 1, 300).collect()}
    assert found == {0: 1, 1: 2, 2: 3}


def test_repeat_window_includes_its_start(logs):
    assert [r.id for r in patterns.repeated_error_candidates(logs(*after(0, 300)), 2, 300).collect()] == [1]
    assert patterns.repeated_error_candidates(logs(*after(0, 300.000001)), 2, 300).count() == 0


def test_only_exact_errors_of_similar_text_repeat(logs):
    rows = [(0, "a", "x" * 30 + "1", "ERROR", START), (1, "a", "x" * 30 + "2", "ERROR", START),
            (2, "a", "x" * 29, "ERROR", START), (3, "a", "x" * 30, "error", START), (4, None, "x" * 30, "ERROR", START),
            (5, None, "x" * 30, "ERROR", START), (6, "a", None, "ERROR", START), (7, "a", "", "ERROR", START)]
    found = {r.id: r.repeat_count for r in patterns.repeated_error_candidates(logs(*rows), 2, 300).collect()}
    assert found == {1: 2, 5: 2, 7: 2}


def test_detector_runs_enabled_patterns_and_survives_a_bad_one(logs):
    class Broken:
        pattern_id = name = description = "broken"
        severity, enabled = "ERROR", True

        def detect(self, frame):
            raise RuntimeError("no plan")

    known = [Broken(), patterns.RepeatedErrorPattern(2, 300), patterns.RepeatedErrorPattern(2, 300, severity="INFO"),
             patterns.RepeatedErrorPattern(2, 300, enabled=False)]
    with pytest.warns(UserWarning, match="broken"):
        found = patterns.detect_patterns(logs(*after(0, 1)), known)
    assert sorted(r.severity for r in found.collect()) == ["INFO", "WARNING"]
    alerts = patterns.pattern_alerts(found).collect()
    assert [(r.severity, r.subject) for r in alerts] == [("WARNING", "Log pattern detected: Repeated error")]


def test_fixed_windows(logs):
    found = patterns.windowed_burst(logs(*after(0, 59.9, 60, 61, 62)), "1 minute", 3).collect()
    assert [(r.scope, r.window_start, r.errors) for r in found] == [("a", START + timedelta(minutes=1), 3)]


def test_running_count(logs):
    found = {r.id: r.running_count for r in patterns.running_count(logs(*after(3, 1, 2))).collect()}
    assert found == {1: 1, 2: 2, 0: 3}


def test_equal_rows_count_each(logs):
    rows = [(7, "a", "same text", "ERROR", "2024-01-01 00:00:00")] * 5
    frame = logs(*rows)
    counts = patterns.repeated_error_counts(frame, 60)
    assert sorted((r.repeat_count, r.position) for r in counts.collect()) == [(k, k) for k in range(1, 6)]
    assert patterns.repeated_error_candidates(frame, 3, 60).count() == 3
    found = patterns.repeated_error(frame, 3, 60).collect()
    assert len(found) == 1 and found[0].additional_data.repeat_count == 3 and len(found[0].related_logs) == 3
    assert patterns.error_burst(frame, 3, 60, 300, scope=None).count() == 1
