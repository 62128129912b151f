"""Job configuration: which types to look for, what to preserve, which patterns to add."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, replace

from inkveil import catalog
from inkveil.functions.portable import portable


@dataclass(frozen=True)
class CustomPattern:
    """A user regex and the prefix it was declared with."""

    regex: str
    prefix: str

    def __post_init__(self) -> None:
        compiled = re.compile(self.regex, re.IGNORECASE)
        if compiled.search("") is not None:
            raise ValueError(f"custom pattern matches the empty string: {self.regex!r}")
        if "[" in self.prefix or "]" in self.prefix:
            raise ValueError(f"a prefix may not hold brackets: {self.prefix!r}")

    @property
    def portable(self) -> bool:
        """Whether the JVM may search it; Python searches the others."""
        return portable(self.regex)


@dataclass(frozen=True)
class Config:
    """Immutable settings; the default looks for every built-in type and preserves nothing.

    ``custom_prefix='fixed'`` writes every custom finding as ``[VAL_nnn]``;
    ``'declared'`` uses the prefix given with the pattern.
    """

    types: frozenset[str] = frozenset(catalog.TYPE_NAMES)
    custom: tuple[CustomPattern, ...] = ()
    preserve: tuple[str, ...] = ()
    custom_prefix: str = "fixed"

    def __post_init__(self) -> None:
        if self.custom_prefix not in ("fixed", "declared"):
            raise ValueError("custom_prefix must be 'fixed' or 'declared'")

    @staticmethod
    def of(
        types: Iterable[str] | None = None,
        *,
        custom: Iterable[tuple[str, str]] = (),
        preserve: Iterable[str] = (),
        preset: str | Mapping | None = None,
        presets: Mapping[str, Mapping] | None = None,
        custom_prefix: str = "fixed",
    ) -> "Config":
        """One-call form. A preset wins over ``types``; ``custom`` and ``preserve`` add to it."""
        base = Config(custom_prefix=custom_prefix)
        if preset is not None:
            base = base.load_preset(preset, presets)
        elif types is not None:
            base = base.only_types(types)
        for regex, prefix in custom:
            base = base.add_custom_pattern(regex, prefix)
        for value in preserve:
            base = base.add_preserve_value(value)
        return base

    def only_types(self, names: Iterable[str]) -> "Config":
        """Enable exactly ``names``; unknown names are ignored."""
        return replace(self, types=frozenset(names) & frozenset(catalog.TYPE_NAMES))

    def set_pattern_enabled(self, name: str, enabled: bool) -> "Config":
        return self.only_types(self.types | {name} if enabled else self.types - {name})

    def add_custom_pattern(self, regex: str, prefix: str = "CUSTOM") -> "Config":
        return replace(self, custom=(*self.custom, CustomPattern(regex, prefix)))

    def add_preserve_value(self, value: str) -> "Config":
        return replace(self, preserve=(*self.preserve, value))

    def load_preset(self, preset: str | Mapping, presets: Mapping[str, Mapping] | None = None) -> "Config":
        """Replace types, preserved values and custom patterns by those of a preset."""
        if isinstance(preset, str):
            known = presets if presets is not None else {p["id"]: p for p in catalog.PRESETS}
            if preset not in known:
                raise ValueError(f"unknown preset {preset!r}")
            preset = known[preset]
        custom = tuple(
            CustomPattern(entry["regex"], entry["prefix"])
            for entry in preset.get("custom_patterns") or ()
            if entry.get("regex") and entry.get("prefix")
        )
        base = self.only_types(name.lower() for name in preset.get("patterns") or ())
        return replace(base, custom=custom, preserve=tuple(preset.get("preserve") or ()))

    def prefix_of(self, pattern: CustomPattern) -> str:
        return pattern.prefix if self.custom_prefix == "declared" else catalog.CUSTOM_PREFIX
