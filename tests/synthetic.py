"""A small log with known truth: a chain of influence, a separate group, two agents with one cause, and noise."""

from __future__ import annotations

import random
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession

from tidemark.plans.analysis import Truth
from tidemark.plans.frame import EVENT_SCHEMA, canonical
from tidemark.plans.shared import stored

START = datetime(2026, 3, 2, 8, tzinfo=timezone.utc)
#: Where the chain, the separate group and the common cause meet.
HUB, OTHER, FORM = "pad.example.net/harvest", "maps.example.org/trail", "forms.example.net/hours"


TRUTH = Truth(
    edges=frozenset({("A", "B"), ("B", "C"), ("B", "D"), ("D", "E"), ("F", "G"), ("G", "H")}), source="A", episode=frozenset(f"t{k}" for k in range(8)),
    confounded=("I", "J"), control=("restrict_writes", f"resource:{HUB}"), apart=frozenset("FGH"),
)

#: (id, minute, actor, action, text, mentions, resource or None); {0} is the resource's address.
STORY = (
    ("t0", 0, "A", "message", "@B from today let us keep the harvest tables on one pad {0}, nobody has to wait for the registrar then", ("B",), HUB),
    ("t1", 6, "B", "message", "@A fine, the harvest tables go onto the pad {0} this minute", ("A",), HUB),
    ("t2", 8, "B", "edit", "put the harvest tables onto the pad {0}", (), HUB),
    ("t3", 15, "C", "visit", "took the harvest tables from the pad {0} and work with them now", (), HUB),
    ("t4", 20, "D", "visit", "my harvest tables come from the pad {0} too, without the registrar", (), HUB),
    ("t5", 25, "D", "edit", "put my own harvest tables onto the pad {0}", (), HUB),
    ("t6", 30, "E", "message", "@D good hint, the harvest tables on the pad {0} are what I use now", ("D",), HUB),
    ("t7", 34, "E", "visit", "fetched the harvest tables from the pad {0}", (), HUB),
    ("o0", 3, "F", "message", "the trail map {0} shows the bridge on the wrong bank", (), OTHER),
    ("o1", 10, "G", "message", "@F right, on the trail map {0} the bridge is on the wrong bank", ("F",), OTHER),
    ("o2", 13, "G", "edit", "moved the bridge on the trail map {0}", (), OTHER),
    ("o3", 21, "H", "message", "@G the bridge on the trail map {0} is right now", ("G",), OTHER),
    ("q0", 62, "keeper", "message", "all of you: enter the hours of this week in the form {0} before noon", (), FORM),
    ("q1", 65, "I", "edit", "entered the hours of this week in the form {0}", (), FORM),
    ("q2", 67, "J", "edit", "entered my hours of this week in the form {0}", (), FORM),
)
NOISE = ("swept the yard", "read two chapters on grafting", "counted the jars in the cellar", "wrote to the seed bank", "mended the west fence", "sorted old invoices", "drew a plan for the new shed", "checked the weather for the weekend", "oiled the gate", "took stock of the tools")


def benchmark(spark: SparkSession, seed: int = 7, noise: int = 6, busy: int = 25) -> tuple[DataFrame, Truth]:
    """The canonical frame of the log, and its truth; equal seeds give equal logs. B is busy beside the chain."""
    rng, rows = random.Random(seed), []

    def add(event_id: str, minute: float, actor: str, action: str, content: str, mentions: tuple = (), resource: str | None = None) -> None:
        touches = resource is not None and action != "message"
        rows.append((
            event_id, START + timedelta(minutes=minute), actor, "human" if actor == "keeper" else "agent", action, resource if touches else None, "resource" if touches else None,
            content, "synthetic", "browser" if touches else None, list(mentions), [resource] if resource else [], None, None, None, actor, None, None, None, event_id, {},
        ))

    for event_id, minute, actor, action, content, mentions, resource in STORY:
        add(event_id, minute, actor, action, content.format(f"https://{resource}"), mentions, resource)
    for actor in "ABCDEFGHIJ":
        for k in range(noise + busy * (actor == "B")):
            minute = rng.uniform(-130, 230)
            minute += 20 * (60 <= minute <= 72)  # nothing else happens around the common cause
            add(f"n{actor}{k}", minute, actor, "message", f"{rng.choice(NOISE)}, entry {actor}{k}")
    return stored(canonical(spark.createDataFrame(rows, EVENT_SCHEMA)), "synthetic"), TRUTH
