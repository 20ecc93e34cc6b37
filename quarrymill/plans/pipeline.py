"""A pipeline as a value: what the corpus is about, how it is cut, which types and steps it has."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field, fields
from typing import Any

TIERS = ("structural", "llm", "derived", "communities")
STRATEGIES = ("plain_text", "structural", "pdf_layout", "markdown_render")
FIELD_TYPES = ("string", "int", "float")


@dataclass
class Step:
    tier: str | None = None
    layer: str | None = None
    ref: str | None = None
    entities: list[str] = field(default_factory=list)
    relations: list[str] = field(default_factory=list)
    threshold: float = 0.75
    config: dict[str, Any] = field(default_factory=dict)

    def key(self) -> str:
        return f"custom:{self.ref}" if self.layer == "custom" else self.tier or "?"


@dataclass
class Chunking:
    strategy: str = "plain_text"
    target_tokens: int = 200
    context: bool = False
    title: str | None = None
    slides: bool = False
    word_space_factor: float | None = None
    tables: str | None = None
    slide_layout: str | None = None
    furniture: dict[str, list[str]] | None = None


@dataclass
class Judge:
    """on_suspicion: notify or suspend."""

    persona: str = "ingest_judge"
    template: str | None = None
    on_suspicion: str = "notify"
    enabled: bool = True


@dataclass
class Pipeline:
    """Built as a chain: Pipeline("a curriculum vitae", "cvs").entity(...).llm([...])."""

    context: str
    target_db: str
    language: str = "en"
    chunking: Chunking = field(default_factory=Chunking)
    entities: dict[str, dict[str, Any]] = field(default_factory=dict)
    relations: dict[str, dict[str, Any]] = field(default_factory=dict)
    index_fields: dict[str, str] = field(default_factory=dict)
    steps: list[Step] = field(default_factory=list)
    extraction_agent: str = "ingest_extractor"
    merge_cross_type: bool = False

    def entity(self, name: str, definition: str, examples: list[str] | None = None, not_: str | None = None) -> Pipeline:
        self.entities[name] = {"definition": definition, "examples": list(examples or [])} | ({"not": not_} if not_ else {})
        return self

    def relation(self, name: str, from_: str, to: str, definition: str = "") -> Pipeline:
        self.relations[name] = {"from": from_, "to": to, "definition": definition}
        return self

    def index(self, name: str, type_: str = "string") -> Pipeline:
        self.index_fields[name] = type_
        return self

    def chunk(self, strategy: str = "plain_text", target_tokens: int = 200, **options: Any) -> Pipeline:
        self.chunking = Chunking(strategy, target_tokens, **options)
        return self

    def _step(self, **kw: Any) -> Pipeline:
        self.steps.append(Step(**kw))
        return self

    def structural(self, entities: list[str] | None = None, relations: list[str] | None = None) -> Pipeline:
        return self._step(tier="structural", entities=entities or [], relations=relations or [])

    def llm(self, entities: list[str], relations: list[str] | None = None) -> Pipeline:
        return self._step(tier="llm", entities=entities, relations=relations or [])

    def derived(self, threshold: float = 0.75) -> Pipeline:
        return self._step(tier="derived", relations=["SIMILAR_TO"], threshold=threshold)

    def communities(self) -> Pipeline:
        return self._step(tier="communities")

    def custom(self, ref: str, **config: Any) -> Pipeline:
        return self._step(layer="custom", ref=ref, config=config)

    def validate(self) -> list[str]:
        """What is wrong with it, for people; nothing if it is right."""
        out: list[str] = []
        for i, s in enumerate(self.steps):
            at = f"steps[{i}] ({s.key()})"
            if s.layer == "custom":
                out += [] if s.ref else [f"{at}: a custom layer needs a ref"]
                continue
            if s.tier is None:
                out.append(f"{at}: needs a tier, or layer custom")
                continue
            if s.tier not in TIERS:
                out.append(f"{at}: no such tier")
            out += [f"{at}: entity type '{e}' is not declared" for e in s.entities if e not in self.entities]
            out += [f"{at}: relation '{r}' is not declared" for r in s.relations if r not in self.relations and r != "SIMILAR_TO"]
        for name, r in self.relations.items():
            out += [f"relations.{name}.{side}: '{r[side]}' is not a declared entity type" for side in ("from", "to") if r[side] not in self.entities]
        out += [f"index.{f}: not a declared entity type, so nothing would fill it" for f in self.index_fields if f not in self.entities]
        out += [f"index.{f}: '{t}' is not one of {', '.join(FIELD_TYPES)}" for f, t in self.index_fields.items() if t not in FIELD_TYPES]
        out += [f"entities.{e}: type names are lower case, or no reply would match" for e in self.entities if e != e.lower()]
        if not self.steps:
            out.append("the pipeline has no steps: it would only write chunks")
        return out

    def build(self) -> dict[str, Any]:
        return {
            "corpus": {"context": self.context, "language": self.language, "target_db": self.target_db},
            "chunking": asdict(self.chunking),
            "types": {"entities": self.entities, "relations": self.relations},
            "index": {k: {"type": t} for k, t in self.index_fields.items()},
            "steps": [asdict(s) for s in self.steps],
            "extraction_agent": self.extraction_agent,
            "merge_cross_type": self.merge_cross_type,
        }

    @classmethod
    def parse(cls, d: dict[str, Any]) -> Pipeline:
        known = lambda kind, x: kind(**{k: v for k, v in x.items() if k in {f.name for f in fields(kind)}})
        c, t = d["corpus"], d.get("types", {})
        return cls(
            c["context"], c["target_db"], c.get("language", "en"), known(Chunking, d.get("chunking", {})), dict(t.get("entities", {})), dict(t.get("relations", {})),
            {k: v.get("type", "string") for k, v in d.get("index", {}).items()}, [known(Step, s) for s in d.get("steps", [])], d.get("extraction_agent", "ingest_extractor"), d.get("merge_cross_type", False),
        )
