"""Parameters of a model, with their defaults, bounds and the combinations that are refused."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field, replace

#: Kinds of priors on the document and the word side.
ALPHA_KINDS, BETA_KINDS = ("dir", "hdp", "hpdd", "pdp", "ng"), ("dir", "hdp", "hpdd", "pdp")
#: Bounds of the Dirichlet weights, discounts and concentrations.
DIRICHLET_BOUNDS, DISCOUNT_BOUNDS, CONCENTRATION_BOUNDS = (1e-4, 1.0), (0.001, 0.98), (0.001, 20_000.0)
#: Fixed value: topics that an assignment can name.
MOST_TOPICS = 32768


@dataclass(frozen=True)
class Prior:
    """One side: discount a and concentration b, and those of its root."""

    kind: str = "hpdd"
    a: float = 0.0
    b: float = 10.0
    a0: float = 0.0
    b0: float = 10.0
    weight: float | None = None  # Dirichlet weight of a topic or word


@dataclass(frozen=True)
class ModelConfig:
    topics: int = 10
    cycles: int = 100
    alpha: Prior = field(default_factory=Prior)
    beta: Prior = field(default_factory=lambda: Prior(a=0.5, b=100.0, a0=0.5, b0=10.0))
    burst_a: float = 0.0
    burst_b: float | None = None  # concentration of repeated words; none: no burstiness
    gamma_rate: float = 1.0
    sparse: tuple[float, float] | None = None  # beta prior of a topic being active in a document
    epochs: int = 1
    seed: int = 7
    min_doc: int = 0
    sample: tuple[str, ...] = ()  # parameters to sample
    sample_start: int = 10
    sample_every: int = 5
    max_seconds: float | None = None

    def __post_init__(self) -> None:
        if not 1 <= self.topics <= MOST_TOPICS:
            raise ValueError(f"topics must be 1 .. {MOST_TOPICS}")
        if self.alpha.kind not in ALPHA_KINDS or self.beta.kind not in BETA_KINDS:
            raise ValueError("unknown kind of prior")
        for p in (self.alpha, self.beta):
            if not 0 <= p.a < 1 or not 0 <= p.a0 < 1 or p.b <= 0 or p.b0 <= 0:
                raise ValueError("discounts must be in [0, 1) and concentrations positive")
            if p.kind == "hdp" and p.a0:
                raise ValueError("an hdp root has no discount; hpdd has")
            if p.kind == "dir" and (p.a or p.a0):
                raise ValueError("a Dirichlet side has no discount")
        if self.sparse and self.alpha.kind != "ng":
            raise ValueError("active topics need the ng document side")
        if self.burst_b is not None and (self.burst_b <= 0 or not 0 <= self.burst_a < 1):
            raise ValueError("burst_b must be positive and burst_a in [0, 1)")
        if self.epochs > 1 and (self.alpha.kind == "ng" or self.burst_b is not None):
            raise ValueError("the epoch model has neither ng documents nor burstiness")
        if unknown := set(self.sample) - {"alpha", "beta", "b", "bw", "a", "aw", "b0", "bw0", "a0", "aw0"}:
            raise ValueError(f"cannot sample {sorted(unknown)}")
        if ("alpha" in self.sample and self.alpha.kind != "dir") or ("beta" in self.sample and self.beta.kind != "dir"):
            raise ValueError("a Dirichlet weight is sampled only where the side is Dirichlet")

    def scaled(self, tokens: int, docs: int) -> ModelConfig:
        """With the default Dirichlet weights for a corpus: 0.05 * tokens / (docs * topics), and 0.001, within bounds."""
        lo, hi = DIRICHLET_BOUNDS
        alpha = self.alpha.weight if self.alpha.weight is not None else min(max(0.05 * tokens / max(docs * self.topics, 1), lo), hi)
        beta = self.beta.weight if self.beta.weight is not None else 0.001
        return replace(self, alpha=replace(self.alpha, weight=alpha), beta=replace(self.beta, weight=beta))

    def as_dict(self) -> dict:
        return asdict(self)

    @classmethod
    def from_dict(cls, d: dict) -> ModelConfig:
        d = dict(d)
        for side in ("alpha", "beta"):
            d[side] = Prior(**d[side])
        d["sample"] = tuple(d["sample"])
        d["sparse"] = tuple(d["sparse"]) if d["sparse"] else None
        return cls(**d)
