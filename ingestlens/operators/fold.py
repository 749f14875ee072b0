"""The lifecycle as a pure function of a key's state and its next event; used by replay and by the stream."""

from __future__ import annotations

from dataclasses import dataclass

from ingestlens.schemas import CANCELLED, COMPLETED, FAILED, IN_PROGRESS, MAX_FILE_BYTES, NOT_COMPLETED

TICK = 300_000_000


@dataclass(frozen=True)
class Rules:
    """Times in microseconds. ``limit``: open batches of the key's account, none for no limit."""

    timeout: int = 3_600_000_000
    limit: int | None = None
    expire_at: str = "deadline"
    expire_on_start: bool = False

    def closes_at(self, started: int) -> int:
        """When a silent batch is closed: at its deadline, or at the first sweep strictly later."""
        deadline = started + self.timeout
        return deadline if self.expire_at == "deadline" else (deadline // TICK + 1) * TICK

    def is_over(self, started: int, now: int) -> bool:
        """A batch exactly at its deadline is still open; a sweep closes before what happens at its time."""
        at = self.closes_at(started)
        return now > at if self.expire_at == "deadline" else now >= at


_ENDS = {"COMPLETE": COMPLETED, "FAIL": FAILED, "CANCEL": CANCELLED}


def _row(b: dict, status: str, at: int | None) -> dict:
    return {
        "kind": "batch", "batch_id": b["batch_id"], "site_id": b["site_id"], "account_id": b["account_id"], "status": status, "started_at": b["at"],
        "completed_at": at, "files": len(b["names"]), "bytes": b["bytes"], "has_errors": b["has_errors"] or status == FAILED,
    }


def close_expired(open_: dict, now: int, rules: Rules) -> list[dict]:
    """Closes and returns the batches that are over at ``now``."""
    over = [s for s, b in open_.items() if rules.is_over(b["at"], now)]
    return [_row(b, NOT_COMPLETED, rules.closes_at(b["at"])) for b in map(open_.pop, over)]


def step(open_: dict, e: dict, rules: Rules) -> list[dict]:
    """Applies event ``e`` to ``open_`` (site -> open batch): closed batches and a rejection, if any.

    What has expired is closed first, so that nothing sees a stale open batch.
    """
    out = close_expired(open_, e["at"], rules)
    site, action = e["site_id"], e["action"]
    b = open_.get(site)

    def reject(reason: str) -> list[dict]:
        return [*out, {"kind": "rejected", "site_id": site, "batch_id": e["batch_id"], "event_id": e["event_id"], "t": e["at"], "action": action, "reason": reason}]

    if action == "START":
        if b and rules.expire_on_start and e["at"] > b["at"] + rules.timeout:
            out.append(_row(open_.pop(site), NOT_COMPLETED, e["at"]))
            b = None
        if b:
            return reject("ACTIVE_EXISTS")
        if rules.limit is not None and len(open_) >= rules.limit:
            return reject("LIMIT")
        name = e["batch_id"] if e["batch_id"] is not None else f"b{e['event_id']}"
        open_[site] = {"batch_id": name, "site_id": site, "account_id": e["account_id"], "at": e["at"], "names": {}, "bytes": 0, "has_errors": False}
        return out
    mine = b is not None and e["batch_id"] in (None, b["batch_id"])
    if action == "ERROR":
        if mine:
            b["has_errors"] = True
        return out
    if not mine:
        return reject("NOT_OPEN")
    if action == "UPLOAD":
        name, size = e["file_name"], e["file_size"] or 0
        if size <= 0:
            return reject("EMPTY_FILE")
        if size > MAX_FILE_BYTES:
            return reject("TOO_LARGE")
        if not name or not name.strip():
            return reject("NAME_BLANK")
        if name in b["names"]:
            return reject("DUPLICATE_NAME")
        b["names"][name] = size
        b["bytes"] += size
        return out
    if action in _ENDS:
        return [*out, _row(open_.pop(site), _ENDS[action], e["at"])]
    return reject("UNKNOWN_ACTION")


def finish(open_: dict, rules: Rules, as_of: int | None) -> list[dict]:
    """What is left of a key after its last event."""
    out = close_expired(open_, as_of, rules) if as_of is not None else []
    return out + [_row(b, IN_PROGRESS, None) for b in open_.values()]
