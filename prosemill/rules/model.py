"""What rule packs compile to. All of it is small, immutable and picklable, so a ruleset travels in a closure."""

from __future__ import annotations

from dataclasses import dataclass, field

KINDS = ("vocab", "pattern", "literal-ban", "metric", "repetition")
SCOPES = ("prose", "heading", "list-item", "anywhere")
#: Names of statistics.
STATS = (
    "em_dash_rate",
    "curly_double_ratio",
    "bold_density",
    "heading_titlecase_fraction",
    "emoji_decoration_count",
    "bullet_boldlead_fraction",
    "tricolon_max_streak",
    "sent_len_cv",
    "opening_ngram_repeat",
    "term_cluster_max",
)
WINDOWS = ("paragraph", "sentence", "document")
#: Repetition variants and the members that each needs unless its rule says otherwise.
VARIANTS = {"near-verbatim": 2, "propositional": 2, "content-family": 3}
LEVELS = {"allow": None, "error": 1, "warn": 2, "note": 3}
#: Messages of rules that give none.
DEFAULT_MESSAGES = {
    "vocab": "AI-tell vocabulary",
    "pattern": "AI writing construction",
    "literal-ban": "chatbot markup artifact",
    "metric": "document-level signal",
    "plugin": "plugin finding",
    "repetition": "repeated content",
}


@dataclass(frozen=True)
class Metric:
    stat: str
    direction: str
    cutoff: float
    per_words: int = 1000
    window: str = "paragraph"
    terms: tuple[str, ...] = ()
    lemmas: tuple[int, ...] = ()

    def fires(self, value: float) -> bool:
        return value > self.cutoff if self.direction == "gt" else value < self.cutoff

    def stricter(self, other: Metric) -> bool:
        return self.cutoff > other.cutoff if self.direction == "gt" else self.cutoff < other.cutoff


@dataclass(frozen=True)
class Repetition:
    variant: str
    threshold: float
    min_members: int
    max_distance: int = 200


@dataclass
class Entry:
    """terms for vocab and literal-ban, regex for pattern."""

    id: str
    terms: list[str] = field(default_factory=list)
    regex: str | None = None
    word_boundary: bool = True
    replacement: str | None = None
    message: str | None = None
    advice: str | None = None
    category: str | None = None


@dataclass
class Group:
    id: str
    kind: str
    tier: int
    category: str
    message: str | None = None
    advice: str | None = None
    enabled: bool = True
    scope: str = "anywhere"
    url: tuple[str, str] | None = None
    entries: list[Entry] = field(default_factory=list)
    metric: Metric | None = None
    repetition: Repetition | None = None


@dataclass
class Ruleset:
    groups: list[Group] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)


@dataclass(frozen=True)
class LoadError:
    path: str
    message: str
    line: int | None = None


class LoadErrors(Exception):
    """Everything that is wrong with the packs, not the first thing only."""

    def __init__(self, errors: list[LoadError]):
        self.errors = errors
        super().__init__("\n".join(f"{e.path}{f':{e.line}' if e.line else ''}: {e.message}" for e in errors))


@dataclass
class Settings:
    """levels: lint levels by group or entry id; max_tier: highest tier reported."""

    levels: dict[str, str] = field(default_factory=dict)
    max_tier: int | None = None
    honor_scope: bool = False

    def level(self, group: str, entry: str | None = None) -> str | None:
        found = {k.lower(): v for k, v in self.levels.items()} if any(k != k.lower() for k in self.levels) else self.levels
        return found.get((entry or group).lower(), found.get(group.lower()))

    def tier(self, group: Group, entry: str | None = None) -> int:
        return LEVELS.get(self.level(group.id, entry) or "") or group.tier

    def live(self, group: Group, by_tier: bool = True) -> bool:
        """Whether a group's rules run at all."""
        fits = not by_tier or self.max_tier is None or group.tier <= self.max_tier
        return group.enabled and self.level(group.id) != "allow" and fits
