"""Proposals of outside workers: their form, their evidence."""

import copy

import pytest

from attestry.operators import proposals


def piece(i, text, role="user", segment=0, covered=False, kind="text"):
    return {"piece_id": i, "text": text, "role": role, "kind": kind, "segment_index": segment, "already_covered": covered}


REQUEST = {"packet_id": "P1", "pieces": [piece("a", "Grüße 🌱"), piece("b", "no", "assistant"), piece("c", "{}", segment=-2), piece("d", "old", covered=True)]}

PROPOSAL = {
    "packet_id": "P1",
    "coverage": [
        {"piece_id": "a", "disposition": "candidate", "reason": "said so", "candidate_ids": ["one"]},
        {"piece_id": "b", "disposition": "candidate", "reason": "said so", "candidate_ids": ["echo-2"]},
        {"piece_id": "c", "disposition": "no_extractable_content", "reason": "no text of its own", "candidate_ids": []},
    ],
    "candidates": [
        {"candidate_id": "one", "category": "other", "attribution": "unknown", "statement": "Grüße 🌱", "uncertainty": "all", "evidence": [{"piece_id": "a", "start": 0, "end": 7, "quote": "Grüße 🌱"}]},
        {"candidate_id": "echo-2", "category": "other", "attribution": "assistant_content", "statement": "no", "uncertainty": "all", "evidence": [{"piece_id": "b", "start": 0, "end": 2, "quote": "no"}]},
    ],
}


def changed(path, value):
    out = copy.deepcopy(PROPOSAL)
    at = out
    for step in path[:-1]:
        at = at[step]
    at[path[-1]] = value
    return out


def test_a_right_proposal_passes():
    assert proposals.check_proposal(REQUEST, PROPOSAL) == []


@pytest.mark.parametrize(
    ("path", "value"),
    [
        (["packet_id"], "P2"), (["more"], 1), (["coverage"], {}), (["coverage"], []), (["coverage", 0, "disposition"], "maybe"), (["coverage", 0, "reason"], " "), (["coverage", 0, "candidate_ids"], []), (["coverage", 0, "piece_id"], "d"),
        (["coverage", 2, "disposition"], "candidate"), (["candidates", 0, "statement"], ""), (["candidates", 0, "attribution"], "owner"), (["candidates", 0, "evidence"], []), (["candidates", 0, "candidate_id"], "echo-2"),
        (["candidates", 0, "evidence", 0, "quote"], "Grüsse"), (["candidates", 0, "evidence", 0, "start"], True), (["candidates", 0, "evidence", 0, "end"], 99), (["candidates", 0, "evidence", 0, "piece_id"], "c"), (["candidates", 0, "evidence", 0, "piece_id"], "x"),
        (["candidates", 1, "attribution"], "owner_statement"), (["candidates", 0, "evidence", 0], {"piece_id": "d", "start": 0, "end": 3, "quote": "old"}),
    ],
)
def test_one_fault_is_one_refusal(path, value):
    assert proposals.check_proposal(REQUEST, changed(path, value))
