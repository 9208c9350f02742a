"""The legacy text form of scalar models, bare or inside XML. It keeps six digits."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from pathlib import Path

from ..operators.emissions import Discrete, Emission, family
from ..operators.model import Hmm

# Names of the families and parameters in the text form.
NAMES = {
    "Discrete": "Discrete",
    "Gaussian": "Gaussian",
    "Exponential": "Exponential",
    "Gamma": "Gamma",
    "LogNormal": "LogNormal",
    "Beta": "Beta",
    "Uniform": "Uniform",
    "Weibull": "Weibull",
    "Pareto": "Pareto",
    "Rayleigh": "Rayleigh",
    "StudentT": "StudentT",
    "ChiSquared": "ChiSquared",
    "VonMises": "VonMises",
    "Poisson": "Poisson",
    "Binomial": "Binomial",
    "NegativeBinomial": "NegativeBinomial",
    "Negative Binomial": "NegativeBinomial",
}
NUMBER = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"


def to_text(model: Hmm) -> str:
    if model.multivariate:
        raise ValueError("the text form is for scalar models")
    row = lambda values: "[ " + " ".join(f"{v:12.6g}" for v in values) + " ]"
    out = ["Hidden Markov Model parameters", f"  States: {model.states}", f"  Pi: {row(model.pi)}", "  Transition matrix:", *(f"   {row(r)}" for r in model.trans), "  Emissions:"]
    for i, e in enumerate(model.emissions):
        out.append(f"   State {i}: {e.tag} Distribution:")
        if isinstance(e, Discrete):
            out += [f"      Number of symbols = {len(e.probs)}", *(f"      P({k}) = {p:.6f}" for k, p in enumerate(e.probs))]
        else:
            out += [f"      {k} = {v:.6g}" for k, v in e.params().items()]
        out.append("")
    return "\n".join(out) + "\n"


def _emission(name: str, body: str) -> Emission:
    if name not in NAMES:
        raise ValueError(f"unknown emission family {name!r}")
    found = re.findall(rf"^\s*([^=\n]+?)\s*=\s*({NUMBER})", body, re.M)
    if NAMES[name] == "Discrete":
        return Discrete(tuple(float(v) for k, v in found if k.startswith("P(")))
    # parameters stand in the order of the family's own; labels differ between writers
    return family(NAMES[name])(*(float(v) for _, v in found))


def from_text(text: str) -> Hmm:
    states = re.search(r"States:\s*(\d+)", text)
    if not states:
        raise ValueError("not a model in text form")
    n = int(states[1])
    head, _, tail = text.partition("Emissions:")
    rows = [[float(v) for v in re.findall(NUMBER, r)] for r in re.findall(r"\[([^\]]*)\]", head)]
    if len(rows) != n + 1 or any(len(r) != n for r in rows):
        raise ValueError("initial and transition probabilities don't fit the number of states")
    parts = re.split(r"State\s+\d+:\s*", tail)[1:]
    if len(parts) != n:
        raise ValueError("as many emissions as states are expected")
    emissions = []
    for part in parts:
        title, _, body = part.partition("\n")
        emissions.append(_emission(re.sub(r"\s*Distribution:?\s*$", "", title.strip()), body))
    return Hmm(tuple(rows[0]), tuple(map(tuple, rows[1:])), tuple(emissions))


def to_xml(model: Hmm, root: str = "hmm_model") -> str:
    """The text form in a root element; any root is read."""
    return f'<?xml version="1.0" encoding="UTF-8"?>\n<{root}>\n<![CDATA[\n{to_text(model)}]]>\n</{root}>\n'


def from_xml(text: str) -> Hmm:
    if "<!DOCTYPE" in text or "<!ENTITY" in text:
        raise ValueError("document types aren't read")
    try:
        root = ET.fromstring(text)
    except ET.ParseError as e:
        raise ValueError(f"not a model in XML: {e}") from e
    return from_text(root.text or "")


def save_xml(model: Hmm, path: str | Path) -> None:
    Path(path).write_text(to_xml(model))


def load_xml(path: str | Path) -> Hmm:
    return from_xml(Path(path).read_text())
