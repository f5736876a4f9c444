"""Configuration from defaults, environment and arguments, later ones first."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import fields

from hexflow.sources.synthetic import Config

PREFIX = "HEXFLOW_"


def generation(arguments: Mapping[str, object] | None = None, environment: Mapping[str, str] | None = None) -> Config:
    """The generator's settings: arguments that are not None, else HEXFLOW_<NAME> variables, else defaults.

    A value of the wrong type, a negative number of players or days, or a noise outside 0 to 1 is an error.
    """
    environment = os.environ if environment is None else environment
    given, base = dict(arguments or {}), Config()
    values = {}
    for f in fields(Config):
        default = getattr(base, f.name)
        raw = given.get(f.name)
        if raw is None:
            raw = environment.get(PREFIX + f.name.upper(), default)
        try:
            values[f.name] = type(default)(raw)
        except ValueError as e:
            raise ValueError(f"{f.name}: {raw!r} is no {type(default).__name__}") from e
    made = Config(**values)
    if made.n_players < 0 or made.n_days < 0 or not 0 <= made.noise <= 1:
        raise ValueError("n_players and n_days must not be negative, noise must lie in 0 to 1")
    return made
