"""The replay against a plain model, for random histories."""

from hypothesis import given, settings
from hypothesis import strategies as st

from ingestlens.operators.fold import TICK, Rules, finish, step

MINUTE = 60_000_000
EVENTS = st.lists(st.tuples(st.integers(0, 300), st.sampled_from(["s1", "s2", "s3"]), st.sampled_from(["START", "UPLOAD", "COMPLETE", "FAIL", "CANCEL", "ERROR"]), st.sampled_from(["x", "y"])), max_size=40)


def model(history, limit, tick):
    """Statuses of all batches in order of their start, by scanning all batches at every event."""
    batches = []

    def over(b, now):
        end = (b["at"] + 60 if not tick else (b["at"] + 60) // 5 * 5 + 5)
        return now > end if not tick else now >= end

    for now, site, action, name in history:
        for b in batches:
            if b["status"] == "IN_PROGRESS" and over(b, now):
                b["status"] = "NOT_COMPLETED"
        mine = [b for b in batches if b["site"] == site and b["status"] == "IN_PROGRESS"]
        if action == "START":
            if not mine and (limit is None or sum(b["status"] == "IN_PROGRESS" for b in batches) < limit):
                batches.append({"site": site, "at": now, "status": "IN_PROGRESS", "names": set(), "errors": False})
        elif mine:
            b = mine[0]
            if action == "UPLOAD":
                b["names"].add(name)
            elif action == "ERROR":
                b["errors"] = True
            else:
                b["status"] = {"COMPLETE": "COMPLETED", "FAIL": "FAILED", "CANCEL": "CANCELLED"}[action]
                b["errors"] |= action == "FAIL"
    return sorted((b["at"], b["site"], b["status"], len(b["names"]), b["errors"]) for b in batches)


@settings(max_examples=300, deadline=None)
@given(EVENTS, st.sampled_from([None, 1, 2]), st.booleans())
def test_fold_equals_model(events, limit, tick):
    history = sorted(events, key=lambda e: e[0])
    rules, open_, out = Rules(60 * MINUTE, limit, "tick" if tick else "deadline"), {}, []
    for i, (at, site, action, name) in enumerate(history):
        out += step(open_, {"at": at * MINUTE, "event_id": i, "site_id": site, "account_id": "a", "batch_id": None, "action": action, "file_name": name, "file_size": 1}, rules)
    out += finish(open_, rules, None)
    got = sorted((b["started_at"] // MINUTE, b["site_id"], b["status"], b["files"], b["has_errors"]) for b in out if b["kind"] == "batch")
    assert got == model(history, limit, tick)


def test_tick_is_strictly_later():
    assert Rules(60 * MINUTE, expire_at="tick").closes_at(0) == 60 * MINUTE + TICK


def test_expire_on_start():
    rules, open_ = Rules(60 * MINUTE, expire_at="tick", expire_on_start=True), {}
    e = {"event_id": 1, "site_id": "s", "account_id": "a", "batch_id": None, "action": "START", "file_name": None, "file_size": None}
    step(open_, e | {"at": 0}, rules)
    closed = step(open_, e | {"at": 61 * MINUTE, "event_id": 2}, rules)
    assert [c["status"] for c in closed] == ["NOT_COMPLETED"] and open_["s"]["at"] == 61 * MINUTE
