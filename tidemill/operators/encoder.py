"""Skills of texts as features of a pipeline: an estimator, its model, and their names."""

from __future__ import annotations

import json

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.functions.skills import SKILLS, skills_in


class _Skills(HasInputCol, HasOutputCol):
    skills = Param(Params._dummy(), "skills", "names of the skills, in the order of the features", TypeConverters.toListString)
    spellings = Param(Params._dummy(), "spellings", "the spellings of each skill, as JSON", TypeConverters.toString)
    min_texts = Param(Params._dummy(), "min_texts", "texts that must name a skill for it to become a feature", TypeConverters.toInt)

    def getSkills(self) -> list[str]:  # noqa: N802 - as accessors of parameters are called
        return self.getOrDefault(self.skills)

    def taxonomy(self) -> dict[str, list[str]]:
        """The spellings of the skills that are features."""
        known = json.loads(self.getOrDefault(self.spellings))
        return {n: known[n] for n in self.getSkills()}


class SkillEncoder(Estimator, _Skills, DefaultParamsReadable, DefaultParamsWritable):
    """Learns which skills become features: those that min_texts texts name, all of them for 0."""

    @keyword_only
    def __init__(self, *, inputCol: str = "text", outputCol: str = "features", skills: list[str] | None = None, spellings: str | None = None, min_texts: int = 0):  # noqa: N803
        super().__init__()
        self._setDefault(inputCol="text", outputCol="features", skills=list(SKILLS), spellings=json.dumps(SKILLS), min_texts=0)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset: DataFrame) -> SkillModel:
        names, least = self.getSkills(), self.getOrDefault(self.min_texts)
        if least:
            found = dataset.select(F.explode(skills_in(F.col(self.getInputCol()), self.taxonomy())).alias("s"))
            often = {r.s for r in found.groupBy("s").count().where(F.col("count") >= least).collect()}  # as many as skills at most
            names = [n for n in names if n in often]
        return self._copyValues(SkillModel()._set(skills=names))._set(skills=names)


class SkillModel(Model, _Skills, DefaultParamsReadable, DefaultParamsWritable):
    """Adds a vector with 1 for each skill that a text names; a null text names none."""

    def __init__(self) -> None:
        super().__init__()
        self._setDefault(inputCol="text", outputCol="features", skills=[], spellings=json.dumps(SKILLS), min_texts=0)

    def names(self) -> list[str]:
        """Names of the features, in order."""
        return [f"skill:{n}" for n in self.getSkills()]

    def _transform(self, dataset: DataFrame) -> DataFrame:
        own = self.getSkills()
        found = skills_in(F.coalesce(F.col(self.getInputCol()), F.lit("")), self.taxonomy()) if own else F.array().cast("array<string>")
        # A lone array is bound once by transform, so that skills are not looked up for each feature.
        ones = F.transform(F.array(found), lambda f: F.transform(F.array(*map(F.lit, own)).cast("array<string>"), lambda n: F.array_contains(f, n).cast("double")))[0]
        return dataset.withColumn(self.getOutputCol(), array_to_vector(ones))
