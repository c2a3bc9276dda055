"""All knobs, as frozen dataclasses; overrides come from a mapping, unknown keys raise."""

from __future__ import annotations

import dataclasses
import os
from typing import Any

# Names and thresholds that results depend on.
QUESTION_TYPES = ("definition_recall", "theorem_statement", "formula_retrieval", "diagram_dependent", "worked_example_reasoning")
DIMENSIONS = ("context_recall", "context_precision", "faithfulness", "answer_relevancy")
CONTENT_TYPES = ("lesson_intro", "explore", "essential_question", "theorem", "definition", "example", "exercise", "reinforce", "error_analysis", "reasoning", "higher_order_thinking", "look_for_relationships", "review", "stem_project", "other")
EXAMPLE_TYPES = ("example", "worked_example", "explore")
DEFINITION_TYPES = ("definition", "lesson_intro", "vocabulary")
METHOD_CUES = ("الحل", "الحلّ", "الخطوة", "بما أن", "إذن", "نعوض", "المثال")
BANNED_PHRASES = ("الصفحة", "في الصفحة", "النص أعلاه", "في النص", "الشكل أعلاه", "الرسم أعلاه", "القطعة أعلاه", "مصطلحات الوحدة")
SYSTEMS = {"proposed": "unit", "b2": "unit", "b1": "page_proxy"}


@dataclasses.dataclass(frozen=True)
class Windows:
    size: int = 512
    overlap: int = 50


@dataclasses.dataclass(frozen=True)
class Representation:
    max_tokens: int = 1800
    chars_per_token: int = 3


@dataclasses.dataclass(frozen=True)
class Gold:
    exact: float = 0.99
    ordinary: float = 0.80
    worked_example: float = 1.00


@dataclasses.dataclass(frozen=True)
class Retrieval:
    top_k: int = 5
    hit_at: tuple[int, ...] = (1, 5)
    context_budget: int = 2560

    @property
    def reported(self) -> tuple[int, ...]:
        """Ranks to report: those up to k, and k."""
        return tuple(sorted({k for k in self.hit_at if k <= self.top_k} | {self.top_k}))


@dataclasses.dataclass(frozen=True)
class Selection:
    quota: int = 20
    oversample: float = 1.5
    candidates_per_task: int = 1
    lesson_share: float = 0.30
    per_chunk: int = 2
    min_example_chars: int = 250
    seed: int = 7


@dataclasses.dataclass(frozen=True)
class Validation:
    min_question: int = 8
    max_question: int = 500
    min_answer: int = 8
    max_answer: int = 1200
    banned: tuple[str, ...] = BANNED_PHRASES


@dataclasses.dataclass(frozen=True)
class Judge:
    mode: str = "auto"
    dimensions: tuple[str, ...] = DIMENSIONS
    max_retries: int = 2
    resamples: int = 2000
    confidence: float = 0.95
    seed: int = 7
    pair: tuple[str, str] = ("proposed", "b2")


@dataclasses.dataclass(frozen=True)
class Settings:
    system: str = "proposed"
    windows: Windows = Windows()
    representation: Representation = Representation()
    gold: Gold = Gold()
    retrieval: Retrieval = Retrieval()
    selection: Selection = Selection()
    validation: Validation = Validation()
    judge: Judge = Judge()
    metadata_chars: int = 12_000

    @property
    def granularity(self) -> str:
        return SYSTEMS[self.system]

    @property
    def recall_name(self) -> str:
        """Recall over pages is a proxy and never shares a name with recall over units."""
        return "gold_unit_recall" if self.granularity == "unit" else "gold_page_recall_proxy"


def override(settings: Any, values: dict[str, Any]) -> Any:
    """A copy with ``values`` replaced, nested ones too; lists become tuples, ``system`` cannot be replaced."""
    known = {f.name: f for f in dataclasses.fields(settings)}
    new = {}
    for key, value in values.items():
        if key not in known or key == "system":
            raise ValueError(f"unknown setting {key!r}")
        old = getattr(settings, key)
        new[key] = override(old, value) if dataclasses.is_dataclass(old) else tuple(value) if isinstance(old, tuple) else value
    return dataclasses.replace(settings, **new)


def as_dict(settings: Any) -> dict[str, Any]:
    """Nested plain values, tuples as lists, for the record of a run."""
    plain = lambda x: {k: plain(v) for k, v in x.items()} if isinstance(x, dict) else [plain(v) for v in x] if isinstance(x, (list, tuple)) else x
    return plain(dataclasses.asdict(settings))


def required(*names: str) -> dict[str, str]:
    """Environment variables that a provider needs; all missing ones are named at once."""
    missing = [n for n in names if not os.environ.get(n)]
    if missing:
        raise SystemExit(f"missing environment variables: {', '.join(missing)}")
    return {n: os.environ[n] for n in names}
