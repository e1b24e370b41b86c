"""What a stored answer was asked with, and whether it may stand for what is asked now.

Every stored window keeps the narrowings of its request in one canonical form: those its question reads, lists that are sets in order, what says
nothing as null. The digest over them tells two narrowings of one name apart; the row limit is kept beside it, as a longer ranking may stand for
a shorter one.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Collection, Mapping, Sequence
from dataclasses import replace
from typing import Any

from pyspark.sql import types as T

from sitelens.functions.requests import BEACON_PATH
from sitelens.operators.questions import Question
from sitelens.plans.request import Request

_TEXTS = T.ArrayType(T.StringType())
#: The narrowings as columns of a ledger.
NARROWINGS = {
    "include_bots": T.BooleanType(), "bot_agents": _TEXTS, "host": T.StringType(), "paths": _TEXTS, "countries": _TEXTS,
    "rendered_only": T.StringType(), "param": T.StringType(), "redirects": _TEXTS,
}


def _set(values: Sequence[str] | None) -> list[str] | None:
    return None if values is None else sorted(set(values))


def narrowings(question: Question, request: Request) -> dict[str, Any]:
    """The canonical narrowings of a request, by ledger column; null where it does not narrow or the question does not read it."""
    agents = [] if request.include_bots else _set([a.lower() for a in request.bot_agents])
    return {
        "include_bots": bool(request.include_bots),
        "bot_agents": agents or None,
        "host": request.host,
        "paths": None if request.paths is None else list(request.paths),  # in order: the first prefix that matches names the section
        "countries": _set(request.countries),
        "rendered_only": request.beacon_path if request.rendered_only else None,
        "param": request.param if "param" in question.reads else None,
        "redirects": _set(request.redirects) if "redirects" in question.reads else None,
    }


def limit_of(question: Question, request: Request) -> int | None:
    return request.limit if question.ranked else None


def digest_of(told: Mapping[str, Any]) -> str:
    """One text for equal narrowings, whatever the limit."""
    return hashlib.sha256(json.dumps({n: told.get(n) for n in NARROWINGS}, sort_keys=True).encode()).hexdigest()


def identity(question: Question, request: Request) -> dict[str, Any]:
    """What the ledger keeps of a request."""
    told = narrowings(question, request)
    return {**told, "limit": limit_of(question, request), "digest": digest_of(told)}


def _taken(request: Request, name: str, value: Any) -> Request:
    """``request`` with one narrowing as it was stored."""
    if name == "rendered_only":
        return replace(request, rendered_only=(True if value == BEACON_PATH else value) if value else False)
    if name == "bot_agents":
        return replace(request, bot_agents=tuple(value or ()))
    if name in ("paths", "countries", "redirects"):
        return replace(request, **{name: None if value is None else tuple(value)})
    return replace(request, **{name: value})


def adopted(question: Question, asked: Request, named: Collection[str], stored: Sequence[Mapping[str, Any]]) -> tuple[Request, list[str]]:
    """The request that stored windows answer, and which of its narrowings were taken from them.

    A narrowing that is ``named`` has to be the stored one everywhere. One that is not is adopted, if all windows agree on it. A ranking may be
    longer than asked; a shorter one is refused if a limit is named, and else shortens the answer.
    """
    own = narrowings(question, asked)
    differing = [n for n in NARROWINGS if any(s[n] != own[n] for s in stored)]
    if all(s["include_bots"] for s in stored):
        differing = [n for n in differing if n != "bot_agents"]  # with all bots, names of some say nothing
    if wrong := [n for n in differing if n in named]:
        raise ValueError(f"stored windows answer something else: they differ in {', '.join(wrong)}")
    taken = []
    for name in differing:
        values = {json.dumps(s[name]) for s in stored}
        if len(values) > 1:
            raise ValueError(f"stored windows were computed in more than one way: name {name}, which is one of {', '.join(sorted(values))}")
        asked = _taken(asked, name, stored[0][name])
        taken.append(f"{name}={json.dumps(stored[0][name])}")
    limits = [s["limit"] for s in stored if s["limit"] is not None]
    if question.ranked and limits and (asked.limit is None or min(limits) < asked.limit):
        if "limit" in named:
            raise ValueError(f"stored windows keep {min(limits)} rows, fewer than are asked for")
        asked = replace(asked, limit=min(limits))
        taken.append(f"limit={asked.limit}")
    return asked, taken
