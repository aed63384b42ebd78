"""One candidate after the other against the active items of a user.

The batch history runs this over sorted rows and the stream over its state: both decide alike.
"""

from __future__ import annotations

import re
from functools import lru_cache

from engram.functions.fixed_values import (
    CORRECTION_SIMILARITY, INFO_GAIN_WRITE_THRESHOLD, MERGE_STABILITY_STEP, NEAR_DUPLICATE,
)
from engram.functions.similarity import subsequence_ratio

TOKEN = re.compile("[a-z0-9]+")
#: Below this the closeness of two contents makes no difference to anything.
SOFT, SAME = 0.75, 0.92


#: Pairs that a worker remembers, and their characters: both bound its memory.
KNOWN_PAIRS, KNOWN_LENGTH = 1 << 14, 512


@lru_cache(maxsize=KNOWN_PAIRS)
def _known_ratio(a: str, b: str) -> float:
    return subsequence_ratio(a, b)


def _ratio(a: str, b: str) -> float:
    return (_known_ratio if len(a) + len(b) <= KNOWN_LENGTH else subsequence_ratio)(a, b)


def closeness(a: str, b: str) -> float:
    """2 LCS / (m + n) of trimmed lower-case contents, or 0 where it is below SOFT."""
    if a == b:
        return 1.0
    if 2 * min(len(a), len(b)) < SOFT * (len(a) + len(b)):
        return 0.0
    ratio = _ratio(a, b)
    return ratio if ratio >= SOFT else 0.0


def may_supersede(candidate: dict, item: dict) -> bool:
    """Speculation replaces neither firm decisions nor what is as certain as itself; only a
    decision, a correction or the user replaces a decision."""
    if candidate["authority"] == "speculation":
        if item["type"] == "decision" and item["confidence"] >= 0.85:
            return False
        if item["confidence"] >= candidate["confidence"]:
            return False
    return (item["type"] != "decision" or candidate["type"] == "decision"
            or candidate["is_correction"] or candidate["authority"] == "user")


class Memory:
    """Active items in the order they came, with what finds them again.

    An item is a dictionary: number (in order of creation), type, topic_key, item_topic (the
    topic it is found by), content, confidence, stability, version, seq, nth (of its type and
    topic), merges.
    """

    def __init__(self, items=()):
        self.items: dict[int, dict] = {}
        self.lengths: dict[str, dict[int, dict[int, str]]] = {}
        self.topics: dict[tuple, dict[int, None]] = {}
        self.tokens: dict[str, dict[int, None]] = {}
        self.made: dict[tuple, int] = {}
        self.next = 0
        for item in items:
            self._put(item)
            self.next = max(self.next, item["number"] + 1)

    def _put(self, item: dict) -> None:
        number, text = item["number"], item["content"].lower()
        self.items[number] = item
        plain = text.strip()
        self.lengths.setdefault(item["type"], {}).setdefault(len(plain), {})[number] = plain
        self.topics.setdefault((item["type"], item["item_topic"]), {})[number] = None
        for t in set(TOKEN.findall(text + " " + (item["topic_key"] or "").lower())):
            self.tokens.setdefault(t, {})[number] = None

    def _drop(self, item: dict) -> None:
        number, text = item["number"], item["content"].lower()
        del self.items[number]
        held = self.lengths[item["type"]]
        del held[len(text.strip())][number]
        if not held[len(text.strip())]:
            del held[len(text.strip())]
        del self.topics[item["type"], item["item_topic"]][number]
        for t in set(TOKEN.findall(text + " " + (item["topic_key"] or "").lower())):
            del self.tokens[t][number]

    def _revoked(self, candidate: dict) -> list[dict]:
        value = (candidate["revoked_value"] or "").lower().strip()
        wanted = set(TOKEN.findall((candidate["revocation_target"] or "").lower()))
        hit = {n for t in wanted for n in self.tokens.get(t, ())}
        if value:
            hit |= {n for n, i in self.items.items() if value in i["content"].lower()}
        return [self.items[n] for n in sorted(hit)]

    def _corrected(self, candidate: dict) -> dict | None:
        """The oldest item that holds the old value, else the one most like it."""
        old = (candidate["old_value"] or "").lower().strip()
        if not old:
            return None
        best, score = None, 0.0
        for item in self.items.values():
            text = item["content"].lower()
            if old in text:
                return item
            near = closeness(old, text.strip())
            if near > score:
                best, score = item, near
        return best if score >= CORRECTION_SIMILARITY else None

    def _near(self, candidate: dict) -> tuple[float, dict | None]:
        """Information gain, and the oldest item of the type with nearly the same content."""
        held = self.lengths.get(candidate["type"])
        if not held:
            return 0.85, None
        text = candidate["content"].lower().strip()
        best, first = 0.0, None
        for length in held:
            if 2 * min(len(text), length) < SOFT * (len(text) + length) and len(text) != length:
                continue
            for number, other in held[length].items():
                near = closeness(text, other)
                best = max(best, near)
                if near >= NEAR_DUPLICATE and (first is None or number < first):
                    first = number
        gain = 0.05 if best >= SAME else 0.25 if best >= SOFT else 0.8
        return gain, None if first is None else self.items[first]

    def apply(self, candidate: dict) -> tuple[str, str, dict | None, dict | None, float, list]:
        """action, reason, item, item superseded, information gain, items revoked."""
        if candidate["revokes"]:
            gone = self._revoked(candidate)
            for item in gone:
                self._drop(item)
            return ("revoke", "revocation", None, None, 0.0, gone) if gone else (
                "skip", "no_revocation_target", None, None, 0.0, [])
        gain, twin = self._near(candidate)

        def start(old):
            chain = candidate["type"], candidate["topic_key"]
            self.made[chain] = self.made.get(chain, 0) + 1
            item = {"number": self.next, "type": candidate["type"],
                    "topic_key": candidate["topic_key"], "item_topic": candidate["item_topic"],
                    "content": candidate["content"], "confidence": candidate["confidence"],
                    "stability": candidate["stability"], "seq": candidate["seq"],
                    "version": old["version"] + 1 if old else 1, "nth": self.made[chain],
                    "merges": 0}
            self.next += 1
            if old:
                self._drop(old)
            self._put(item)
            return item
        target = self._corrected(candidate)
        if target is not None and may_supersede(candidate, target):
            return "supersede", "correction", start(target), target, gain, []
        if twin is not None:
            twin["confidence"] = max(twin["confidence"], candidate["confidence"])
            twin["stability"] = min(1.0, max(twin["stability"], candidate["stability"])
                                    + MERGE_STABILITY_STEP)
            twin["merges"] += 1
            return "merge", "near_duplicate", twin, None, gain, []
        same = self.topics.get((candidate["type"], candidate["topic_key"])) \
            if candidate["topic_key"] else None
        if same:
            item = self.items[min(same)]
            if not may_supersede(candidate, item):
                return "reject", "speculation", item, None, gain, []
            return "supersede", "topic_contradiction", start(item), item, gain, []
        if gain < INFO_GAIN_WRITE_THRESHOLD:
            return "skip", "low_information_gain", None, None, gain, []
        return "create", "new_topic", start(None), None, gain, []
