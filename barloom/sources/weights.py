"""The weight store of a search: one JSON document with weights, statistics, audits and what is disabled, by name.

The document is kept in numbered versions, `<path>.d/<number>.json`; a file at path itself is where version 1 starts from. To write the next
version a writer must make the empty file that claims its number, which only one can do, and moves the finished document to its place. Who comes
second loads what the first has written and does its own changes to that: updates and toggles are done again, in order, and names
that were set directly are set. So several loops learn into one document and nobody's runs are lost. Readers see whole versions only.
"""

from __future__ import annotations

import copy
import json
import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from barloom.sources.shared import create_exclusively

KINDS = {"feature": "features", "target": "targets", "model": "models"}
LONG = "kind string, name string, weight double, n long, mean double, best double, last double, disabled boolean"
#: Off unless someone turns them on after loading.
DISABLED = {"models": ("rf_baseline", "logistic_baseline"), "targets": ("updown_margin_H12_k075",)}
KEPT = 8  # versions
STALE = 60.0  # seconds after which a claim without a document is given up
PARTS = ("features", "targets", "models", "k_weights", "features_stats", "targets_stats", "models_stats", "model_target_stats", "features_audit")


def _files(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()), jpath


def _ema(old: float, score: float, alpha: float) -> float:
    return (1 - alpha) * old + alpha * score


@dataclass
class WeightStore:
    features: dict[str, float] = field(default_factory=dict)
    targets: dict[str, float] = field(default_factory=dict)
    models: dict[str, float] = field(default_factory=dict)
    k_weights: dict[str, float] = field(default_factory=dict)
    features_stats: dict[str, dict] = field(default_factory=dict)
    targets_stats: dict[str, dict] = field(default_factory=dict)
    models_stats: dict[str, dict] = field(default_factory=dict)
    model_target_stats: dict[str, dict[str, dict]] = field(default_factory=dict)
    features_audit: dict[str, dict] = field(default_factory=dict)
    disabled_features: list[str] = field(default_factory=list)
    disabled_targets: list[str] = field(default_factory=list)
    disabled_models: list[str] = field(default_factory=list)

    def __post_init__(self):
        self._version, self._done = 0, []
        self._base = self._state()

    # ---- the document

    def _state(self) -> dict:
        return copy.deepcopy({k: getattr(self, k) for k in (*PARTS, *[f"disabled_{k}" for k in KINDS.values()])})

    @staticmethod
    def _latest(spark: SparkSession, path: str) -> int:
        """The highest version that is there; 0 where there is none."""
        fs, folder = _files(spark, f"{path}.d")
        names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        return max((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=0)

    @staticmethod
    def _place(path: str, version: int) -> str:
        return f"{path}.d/{version:09d}.json" if version else path

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "WeightStore":
        """What the latest version says; defaults where there is none. One that can't be read raises ValueError, so that nothing is learnt into a fresh document by mistake."""
        version = cls._latest(spark, path)
        fs, jpath = _files(spark, cls._place(path, version))
        found = {}
        if fs.exists(jpath):
            try:
                found = json.loads("\n".join(r[0] for r in spark.read.text(cls._place(path, version), wholetext=True).collect()))
            except ValueError as error:
                raise ValueError(f"{cls._place(path, version)} is no weight document: {error}") from error
        out = cls(**{k: found.get(k) or {} for k in PARTS}, **{f"disabled_{k}": list(found.get(f"disabled_{k}") or []) for k in KINDS.values()})
        for kind, names in DISABLED.items():
            off = getattr(out, f"disabled_{kind}")
            off += [n for n in names if n not in off]
        out._version, out._done, out._base = version, [], out._state()
        return out

    def save(self, spark: SparkSession, path: str) -> None:
        """Write the next version. Where others have written since this one was loaded, their document with this one's changes."""
        while True:
            latest = self._latest(spark, path)
            if latest != self._version:
                self._onto(WeightStore.load(spark, path))
            number = self._version + 1
            fs, claim = _files(spark, f"{path}.d/{number:09d}.claim")
            if create_exclusively(spark, f"{path}.d/{number:09d}.claim"):
                if self._latest(spark, path) >= number:  # written, and its claim cleared, since we looked
                    fs.delete(claim, False)
                    continue
                _, beside = _files(spark, f"{path}.d/{number:09d}.new")
                out = fs.create(beside, True)
                out.write(bytearray(json.dumps(self._state(), ensure_ascii=False, indent=2, sort_keys=True).encode()))
                out.close()
                if not fs.rename(beside, _files(spark, self._place(path, number))[1]):
                    raise OSError(f"could not write {self._place(path, number)}")
                fs.delete(claim, False)
                fs.delete(_files(spark, self._place(path, number - KEPT))[1], False) if number > KEPT else None
                self._version, self._done, self._base = number, [], self._state()
                return
            if fs.exists(claim) and time.time() - fs.getFileStatus(claim).getModificationTime() / 1000 > STALE and self._latest(spark, path) < number:
                fs.delete(claim, False)  # its writer has died
            time.sleep(0.05)

    def _onto(self, theirs: "WeightStore") -> None:
        """Become `theirs` with this one's changes since it was loaded."""
        mine, expected = self._state(), WeightStore(**copy.deepcopy(self._base))
        for name, args in self._done:
            getattr(expected, name)(*args)
        done, set_by_hand = self._done, expected._state()
        for name, args in done:
            getattr(theirs, name)(*args)
        for part, values in mine.items():
            was, now = set_by_hand[part], getattr(theirs, part)
            if isinstance(values, list):
                now += [v for v in values if v not in was and v not in now]
                now[:] = [v for v in now if v in values or v not in was]
            else:
                now |= {k: v for k, v in values.items() if k not in was or was[k] != v}
                for k in set(was) - set(values):
                    now.pop(k, None)
        for part in mine:
            setattr(self, part, getattr(theirs, part))
        self._version, self._base = theirs._version, theirs._base
        self._done = done

    @staticmethod
    def reset(spark: SparkSession, path: str) -> "WeightStore":
        """Remove the document with all versions; the defaults."""
        for p in (path, f"{path}.d"):
            fs, jpath = _files(spark, p)
            fs.delete(jpath, True)
        return WeightStore.load(spark, path)

    # ---- reading

    def weight(self, kind: str, name: str) -> float:
        """0 where disabled, 1 where unknown."""
        return 0.0 if name in getattr(self, f"disabled_{KINDS[kind]}") else float(getattr(self, KINDS[kind]).get(name, 1.0))

    def long_form(self, spark: SparkSession) -> DataFrame:
        """kind, name, weight, n, mean, best, last, disabled: one row for each name that the document mentions."""
        rows = []
        for kind, part in KINDS.items():
            weights, stats, off = getattr(self, part), getattr(self, f"{part}_stats"), getattr(self, f"disabled_{part}")
            for name in sorted({*weights, *stats, *off}):
                s = stats.get(name, {})
                rows.append((kind, name, float(weights.get(name, 1.0)), int(s.get("n", 0)), float(s.get("mean", 0.0)), float(s.get("best", 0.0)), s.get("last"), name in off))
        rows += [("k", name, float(w), 0, 0.0, 0.0, None, False) for name, w in sorted(self.k_weights.items())]
        return spark.createDataFrame(rows, LONG)

    # ---- changes

    def toggle(self, kind: str, name: str, on: bool) -> None:
        self._done.append(("toggle", (kind, name, on)))
        off = getattr(self, f"disabled_{KINDS[kind]}")
        if on:
            off[:] = [n for n in off if n != name]
        elif name not in off:
            off.append(name)
        getattr(self, KINDS[kind])[name] = 1.0 if on else 0.0

    def _scored(self, kind: str, name: str, score: float, alpha: float) -> None:
        if self.weight(kind, name) <= 0:
            return  # disabled or frozen
        part = KINDS[kind]
        getattr(self, part)[name] = _ema(getattr(self, part).get(name, 1.0), score, alpha)
        stats = getattr(self, f"{part}_stats")
        s = stats.get(name) or {"n": 0, "mean": 0.0, "best": 0.0}
        n = s["n"] + 1
        stats[name] = {"n": n, "mean": s["mean"] + (score - s["mean"]) / n, "best": max(s["best"], score), "last": score}

    def update(self, selection: dict, score: float | None, affinity: dict[str, float], failed: list[str], alpha: float = 0.2) -> None:
        """What one successful run teaches: its score for target, model and feature count, each feature's own, and halves for failed ones."""
        self._done.append(("update", copy.deepcopy((selection, score, affinity, failed, alpha))))
        if score is not None:
            self._scored("target", selection["target"], score, alpha)
        for f in selection["features"]:
            self._scored("feature", f, affinity.get(f, 0.0), alpha)
        if score is not None:
            self._scored("model", selection["model"], score, alpha)
            k = f"k_{len(selection['features'])}"
            self.k_weights[k] = _ema(self.k_weights.get(k, 1.0), score, alpha)
        for f in failed:
            self.features[f] = max(0.0, self.features.get(f, 1.0) / 2)
