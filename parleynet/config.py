"""Parameters of an analysis. Nothing about actors, dates or outlets is fixed in the engine."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Axis:
    """What an analysis is about: actors with their blocs in display order, and the sets that measures refer to."""

    blocs: dict[str, str]
    focal: tuple[str, ...] = ()
    dyad: tuple[str, ...] = ()
    focus: str | None = None
    principals: tuple[str, ...] = ()
    mediators: tuple[str, ...] = ()
    boundary: str = "9999-12-31"
    colours: dict[str, str] = field(default_factory=dict)
    default_bloc: str = "International"

    @property
    def order(self) -> dict[str, int]:
        return {actor: i for i, actor in enumerate(self.blocs)}


#: Polarity to valence, modalities that are no event, speakers that are commentary.
VALENCE = {"positive": "coop", "negative": "conflict", "neutral": "neutral"}
NON_EVENTS = ("negated", "hypothetical", "future")
COMMENTATORS = ("analyst", "journalist", "unknown")
#: Substrings of a verb that mark brokering.
BROKERING = ("broker", "mediate", "facilitate", "host", "convene", "shuttle", "bring together", "go-between", "pass message", "relay")
#: Stems by which a display picks acts of mediation.
MEDIATING = (
    "broker", "mediat", "facilitat", "host", "conven", "relay", "shuttle", "intermediar", "go-between", "go between", "bring together", "urge", "call for", "called for", "call on",
    "called on", "push for", "pressing", "press for", "negotiat", "de-escalat", "de escalat", "deescalat", "dialogue", "resume talks", "return to", "engage", "restraint", "talks between",
)
#: Relation types of the event-typed mode, with weight and valence.
RELATIONS = {
    "HOST_TALKS": (8.0, "coop"), "MEDIATE": (7.0, "coop"), "CONSULT": (5.0, "coop"), "AGREE": (6.0, "coop"), "SUPPORT": (4.0, "coop"), "AID": (5.0, "coop"), "CONCEDE": (3.0, "coop"),
    "DEMAND": (-3.0, "conflict"), "DISAPPROVE": (-2.0, "conflict"), "REJECT": (-4.0, "conflict"), "THREATEN": (-6.0, "conflict"), "SANCTION": (-5.0, "conflict"), "ASSAULT": (-9.0, "conflict"),
}
