"""Skills named in a text: the text is cut into words once, and spellings are looked up."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Skills and the spellings that mean them.
SKILLS: dict[str, list[str]] = {
    "python": ["python"],
    "r": ["r language", "r programming"],
    "java": ["java"],
    "scala": ["scala"],
    "go": ["golang", "go lang"],
    "c++": ["c++", "cpp"],
    "c#": ["c#", "csharp"],
    "javascript": ["javascript"],
    "typescript": ["typescript"],
    "rust": ["rust"],
    "bash": ["bash", "shell scripting"],
    "sql": ["sql"],
    "postgresql": ["postgres", "postgresql", "pgvector"],
    "mysql": ["mysql"],
    "mongodb": ["mongodb", "mongo"],
    "redis": ["redis"],
    "elasticsearch": ["elasticsearch", "opensearch"],
    "snowflake": ["snowflake"],
    "bigquery": ["bigquery"],
    "redshift": ["redshift"],
    "pandas": ["pandas"],
    "numpy": ["numpy"],
    "spark": ["spark", "pyspark"],
    "hadoop": ["hadoop"],
    "kafka": ["kafka"],
    "airflow": ["airflow"],
    "dbt": ["dbt"],
    "databricks": ["databricks"],
    "scikit-learn": ["scikit-learn", "sklearn", "scikit learn"],
    "xgboost": ["xgboost"],
    "lightgbm": ["lightgbm"],
    "machine learning": ["machine learning"],
    "deep learning": ["deep learning"],
    "statistics": ["statistics", "statistical modelling", "statistical modeling"],
    "a/b testing": ["a/b testing", "ab testing", "experimentation"],
    "time series": ["time series", "forecasting"],
    "recommender systems": ["recommender", "recommendation systems"],
    "reinforcement learning": ["reinforcement learning", "rlhf"],
    "pytorch": ["pytorch", "torch"],
    "tensorflow": ["tensorflow"],
    "keras": ["keras"],
    "jax": ["jax"],
    "hugging face": ["hugging face", "huggingface"],
    "transformers": ["transformers", "transformer models"],
    "llm": ["llm", "llms", "large language model", "large language models"],
    "rag": ["rag", "retrieval augmented generation"],
    "prompt engineering": ["prompt engineering", "prompting"],
    "fine-tuning": ["fine-tuning", "fine tuning", "finetuning"],
    "lora": ["lora", "peft", "qlora"],
    "embeddings": ["embeddings", "embedding models"],
    "vector database": ["vector database", "vector db", "pinecone", "weaviate", "faiss"],
    "langchain": ["langchain"],
    "llamaindex": ["llamaindex", "llama index"],
    "nlp": ["nlp", "natural language processing"],
    "computer vision": ["computer vision", "image recognition"],
    "aws": ["aws", "amazon web services"],
    "gcp": ["gcp", "google cloud"],
    "azure": ["azure"],
    "docker": ["docker"],
    "kubernetes": ["kubernetes", "k8s"],
    "terraform": ["terraform"],
    "ci/cd": ["ci/cd", "cicd", "continuous integration"],
    "git": ["git", "github", "gitlab"],
    "linux": ["linux", "unix"],
    "mlops": ["mlops"],
    "mlflow": ["mlflow"],
    "kubeflow": ["kubeflow"],
    "sagemaker": ["sagemaker"],
    "vertex ai": ["vertex ai"],
    "vllm": ["vllm"],
    "fastapi": ["fastapi"],
    "flask": ["flask"],
    "django": ["django"],
    "rest api": ["rest api", "restful"],
    "graphql": ["graphql"],
    "streamlit": ["streamlit"],
    "tableau": ["tableau"],
    "power bi": ["power bi", "powerbi"],
    "looker": ["looker"],
    "excel": ["excel"],
}

# A word runs over letters, digits, + and #, and over a dot that a letter or digit follows.
_WORD = r"[\p{L}\p{N}+#]+(?:\.(?=[\p{L}\p{N}])[\p{L}\p{N}+#]+)*"
_PIECES = rf"({_WORD}|[^\p{{L}}\p{{N}}+#])"


def _cut(spelling: str) -> list[str]:
    """Words of a spelling and the single characters between them."""
    out, word = [], ""
    for c in spelling:
        if c.isalnum() or c in "+#":
            word += c
        else:
            out += [word, c] if word else [c]
            word = ""
    return out + [word] if word else out


def skills_in(text: Column, taxonomy: Mapping[str, Sequence[str]] = SKILLS) -> Column:
    """Sorted names of the skills whose spellings stand in the text as whole words, in any case.

    A letter, digit, + or # beside a spelling makes it another word, and so does a dot with a letter
    or digit behind it; a dot that ends a sentence does not. Null has no skills.
    """
    names = {spelling: name for name, spellings in taxonomy.items() for spelling in spellings}
    sizes = sorted({len(_cut(s)) for s in names})
    pieces = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(_PIECES), F.lit(1))

    def runs(p: Column, n: int, heads: list[str]) -> Column:
        """Runs of n pieces that begin with the first word of a spelling."""
        at = F.array_compact(F.transform(p, lambda x, i: F.when(x.isin(*heads), i)))
        return F.transform(at, lambda i: F.array_join(F.slice(p, i + 1, n), ""))

    def found(p: Column) -> Column:
        parts = []
        for n in sizes:
            own = [s for s in names if len(_cut(s)) == n]
            parts.append(F.array_intersect(runs(p, n, sorted({_cut(s)[0] for s in own})) if n > 1 else p, F.array(*map(F.lit, own))))
        return F.concat(*parts)

    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    # The pieces are bound once by a transform over one array, so they are not cut again for each use.
    hits = F.transform(F.array(pieces), found)[0]
    return F.array_sort(F.array_distinct(F.transform(hits, lambda s: F.try_element_at(table, s))))
