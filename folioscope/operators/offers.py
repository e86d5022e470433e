"""Offers to members: what suppresses one, and what an answer to one does, entry by entry of a session's log.

An offer is not made while the session has a live or declined one of the same kind and targets, or from the same input; an offer that has run out unanswered suppresses nothing.
An answer must come from the offer's member, under a request id that is new or was used for the very same answer, before the offer runs out, for its exact revision and hash, and
under the policy that the offer was made under; a second answer that says the same is the first one again.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The states of an offer that suppress another, and what a decision makes of it.
SUPPRESSING = ("offered", "declined")
DECIDED = {"accept": "accepted", "decline": "declined"}
_IN = ["session", "at", "seq", "op", "member", "kind", "targets", "input_hash", "expires", "policy", "offer", "request", "decision", "revision", "hash"]


class Session:
    """The offers of one session and the request ids that answered them."""

    def __init__(self) -> None:
        self.offers, self.requests = {}, {}

    def issue(self, at: int, seq, member, kind, targets, input_hash, expires: int, policy, hash_) -> tuple:
        same = None
        for i, o in self.offers.items():
            alike = (o["kind"], o["targets"]) == (kind, targets) or (input_hash is not None and o["input_hash"] == input_hash)
            if alike and o["status"] in SUPPRESSING and not (o["status"] == "offered" and o["expires"] <= at):
                same = i  # the last is the most recent
        if same is not None:
            return "suppressed", same
        self.offers[seq] = {"member": member, "kind": kind, "targets": targets, "input_hash": input_hash, "expires": expires, "policy": policy, "hash": hash_, "status": "offered"}
        return "offered", seq

    def respond(self, at: int, member, offer, request, decision, revision, hash_, policy) -> tuple:
        o = self.offers.get(offer)
        if o is None or o["member"] != member:
            return "not_found", None
        payload = (offer, decision, revision, hash_)
        if request in self.requests:
            return ("replayed" if self.requests[request] == payload else "idempotency_conflict"), offer
        if o["status"] == "expired":
            return "expired", offer
        if o["status"] == "stale":
            return "stale", offer
        if o["status"] in DECIDED.values():
            return ("same" if hash_ == o["hash"] and DECIDED.get(decision) == o["status"] else "revision_conflict"), offer
        if o["expires"] <= at:
            o["status"] = "expired"
            return "expired", offer
        if revision != 1 or hash_ != o["hash"] or decision not in DECIDED:
            return "revision_conflict", offer
        if policy != o["policy"]:
            o["status"] = "stale"
            return "stale", offer
        o["status"] = DECIDED[decision]
        self.requests[request] = payload
        return o["status"], offer


def answered(log: DataFrame) -> DataFrame:
    """session, at, seq, op, outcome, about (the offer that is made, suppresses, or is answered) of each entry, in the order of (at, seq).

    ``log``: session, at and expires in milliseconds, seq (an offer's id), op (issue, respond), member, kind, targets (sorted, as text), input_hash, policy, hash; offer, request, decision, revision of answers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, session = object(), Session()
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["session"] != now:
                    now, session = row["session"], Session()
                if row["op"] == "issue":
                    out.append(session.issue(*[row[c] for c in ("at", "seq", "member", "kind", "targets", "input_hash", "expires", "policy", "hash")]))
                else:
                    out.append(session.respond(*[row[c] for c in ("at", "member", "offer", "request", "decision", "revision", "hash", "policy")]))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("session", "at", "seq", "op")], pa.array([o for o, _ in out], pa.string()), pa.array([a for _, a in out], pa.int64())], names=["session", "at", "seq", "op", "outcome", "about"])

    kinds = {"at": "long", "seq": "long", "op": "string", "expires": "long", "offer": "long", "revision": "int"}
    slim = log.select(*[F.col(c).cast(kinds[c]).alias(c) if c in kinds else F.col(c) for c in _IN])
    return slim.repartition("session").sortWithinPartitions("session", "at", "seq").mapInArrow(run, f"session {slim.schema['session'].dataType.simpleString()}, at long, seq long, op string, outcome string, about long")
