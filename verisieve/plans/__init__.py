"""Plans of the engine."""

from verisieve.plans import catalogue  # noqa: F401  (fills the registry)
