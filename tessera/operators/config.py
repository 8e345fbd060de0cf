"""Weights, survivorship and risk rules from a YAML file; what it leaves out keeps its value here."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from tessera.operators.golden import Survivorship
from tessera.operators.matching import Matcher, Weights
from tessera.operators.risk import RiskRules


@dataclass(frozen=True)
class Config:
    matcher: Matcher = field(default_factory=Matcher)
    survivorship: Survivorship = field(default_factory=Survivorship)
    risk: RiskRules = field(default_factory=RiskRules)

    @classmethod
    def load(cls, path: str) -> Config:
        """Sections entity_resolution.weights, golden_record.source_priorities and .strategies, risk_scoring."""
        import yaml

        with open(path, encoding="utf-8") as file:
            found = yaml.safe_load(file) or {}
        weights = (found.get("entity_resolution") or {}).get("weights") or {}
        golden, risk = found.get("golden_record") or {}, found.get("risk_scoring") or {}
        levels, shells = risk.get("risk_levels") or {}, risk.get("shell_company_indicators") or {}
        given = {
            "nominee": risk.get("nominee_director_threshold"),
            "shell_employees": shells.get("max_employees"),
            "pep_score": risk.get("pep_risk_score"),
            "high": levels.get("high"),
            "medium": levels.get("medium"),
        }
        rules = Survivorship()
        return cls(
            Matcher(replace(Weights(), **weights)),
            replace(
                rules,
                priorities=golden.get("source_priorities") or rules.priorities,
                strategies=golden.get("strategies") or rules.strategies,
            ),
            replace(RiskRules(), **{name: value for name, value in given.items() if value is not None}),
        )
