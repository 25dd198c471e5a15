import hashlib
import random
import re
import zlib

import pytest

from tessera.llm import dialogue as D

FOLLOWS = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
FULL = {"u": "user", "a": "assistant"}
SCHEMA = "conv_id bigint, turn bigint, role string, text string, conv int, place string"


def brute_best(rows):
    """(cost, audit, lines) of the cheapest edits of (role, text, fault), least by audit; from the last row to the first."""

    def inserted(best):
        for _ in range(4):
            for q in ("", "s", "u", "a"):
                for r in "ua":
                    to = best.get(FOLLOWS.get((q, r), "none"))
                    if to and (best[q] is None or (to[0] + 3, "I" + to[1]) < best[q][:2]):
                        best[q] = (to[0] + 3, "I" + to[1], [FULL[r] + ":"] + to[2])
        return best

    best = inserted({"": (0, "", []), "s": None, "u": None, "a": (0, "", [])})
    for role, text, fault in reversed(rows):
        now = {}
        for q in best:
            ways = [(best[q][0] + 4, "D" + best[q][1], best[q][2])]
            for edit, r, name, cost in (("K", role[:1], role, 0), ("R", "u", "user", 3), ("R", "a", "assistant", 3)):
                to = best.get(FOLLOWS.get((q, r), "none"))
                if to and fault not in ("blank", "duplicate"):
                    ways.append((to[0] + cost + 3 * (fault == "truncated"), edit + to[1], [f"{name}:{text}"] + to[2]))
            now[q] = min(ways, key=lambda w: w[:2])
        best = inserted(now)
    return best[""]


def brute(rows, hurt=True):
    out, told = {}, {}
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        key = ":".join(" " if x is None else str(x) for x in (conv, turn))
        fate = zlib.crc32(key.encode()) % 20 if hurt else 9
        own = out.setdefault(conv, [])
        if fate:
            text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
            own += [(turn, "user" if fate == 4 else role, text)] * (1 + (fate == 3))
    for conv, rows in out.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        seen, faults = set(), []
        for _, role, text in rows:
            chars = re.findall(r"[^\x20\x09-\x0D]", text)
            faults.append((role, text, "blank" if not chars else "duplicate" if (role, text) in seen else "" if chars[-1] in ".!?" else "truncated"))
            seen.add((role, text))
        turns = {t for t, _, _ in rows if t is not None}
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(faults, faults[1:]))
        cost, audit, lines = brute_best(faults)
        counts = [sum(f == k for _, _, f in faults) for k in ("blank", "duplicate", "truncated")]
        told[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return told


def conversations(n=150):
    """Odd conversations: null ids, turns, roles and texts, unknown and empty roles, one turn twice, repeats, one very long."""
    rng = random.Random(4)
    rows = [(0, t, "user" if t % 2 else "assistant", rng.choice(["Yes.", "no", "", f"Line {t}!", "x " * 2000 + "."])) for t in range(900)]
    for c in range(1, n):
        for t in range(rng.randint(1, 9)):
            role = rng.choice(["system", "user", "assistant", "user", "assistant", "tool", None, "", "User"])
            rows.append((c if c % 40 else None, rng.choice([t, t, t, None]) if c % 7 == 0 else t + 100 * (c if c % 40 == 0 else 0), role, rng.choice(["Fine.", "cut off", " \t", None, "é?", f"Text {c} {t}. ", "a\n.", "end "])))
    keyed = {(c, t, r): (c, t, r, x) for c, t, r, x in rows}  # the order of rows of one turn and role is free
    return list(keyed.values()) + [(7, 1, "user", "Again.")] * 3 + [(7, 1, "user", "Again.")]


def got(spark, rows, monkeypatch=None):
    class Reader:
        class read:
            @staticmethod
            def parquet(path):
                return spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(3)

    return {r.conv_id: tuple(r)[1:] for r in D.query(Reader, "-").collect()}


def test_repair_matches_brute_force(spark):
    rows = [r for r in conversations() if r[2] != ""]
    assert got(spark, rows) == brute(rows)


def test_a_conversation_over_many_stretches(spark, monkeypatch):
    whole = D.repaired
    monkeypatch.setattr(D, "repaired", lambda rows: whole(rows, rows_a_task=20))
    rows = [r for r in conversations(60) if r[2] != ""]
    assert got(spark, rows) == brute(rows)


def test_empty_roles_are_not_kept_and_an_empty_table_gives_none(spark):
    rows = [(1, 0, "", "Hm."), (1, 1, "user", "Yes."), (1, 2, "assistant", "No.")]
    edits = D.repaired(spark.createDataFrame([(*r, 0, "") for r in rows], SCHEMA)).orderBy("place").collect()
    assert [(e.edit, e.role, e.cost) for e in edits] == [("D", "", 4), ("K", "user", 0), ("K", "assistant", 0)]
    assert D.repaired(spark.createDataFrame([], SCHEMA)).count() == 0
    assert got(spark, []) == {}


def test_the_table_is_small_and_filled_as_needed():
    auto = D.Automaton()
    assert len(auto.vectors) == 1 and (auto.back < 0).all()
    assert len(auto.every()) == 30


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_query_on_the_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"/root/testdata/{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert {r.conv_id: tuple(r)[1:] for r in D.query(spark, f"/root/testdata/{sf}").collect()} == brute(rows)
