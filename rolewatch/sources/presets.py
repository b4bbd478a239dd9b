"""Starter lists of companies, as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Keywords the starter lists come with.
ROLE_KEYWORDS = ["intern", "internship", "new grad", "graduate", "early career", "university"]
EVENT_KEYWORDS = ["student", "university", "early career", "campus", "event"]
SYNC_EVENT_KEYWORDS = EVENT_KEYWORDS + ["workshop", "hackathon"]

# Preset, name, domain, career page, early-careers page.
PRESETS = [
    ("maango", "Meta", "metacareers.com", "https://www.metacareers.com/jobs/", "https://www.metacareers.com/careerprograms/students/"),
    ("maango", "Apple", "apple.com", "https://jobs.apple.com/en-us/search", "https://www.apple.com/careers/us/students.html"),
    ("maango", "Amazon", "amazon.jobs", "https://www.amazon.jobs/en/", "https://www.amazon.jobs/content/en/career-programs/university"),
    ("maango", "Netflix", "jobs.netflix.com", "https://explore.jobs.netflix.net/careers", None),
    ("maango", "Google", "google.com", "https://www.google.com/about/careers/applications/jobs/results/", None),
    ("maango", "Oracle", "oracle.com", "https://www.oracle.com/careers/", "https://www.oracle.com/careers/students-grads/"),
    ("unicorn-scaleups", "Together AI", "together.ai", "https://www.together.ai/careers", None),
    ("unicorn-scaleups", "Stripe", "stripe.com", "https://stripe.com/jobs/search", None),
    ("unicorn-scaleups", "Notion", "notion.com", "https://www.notion.com/careers?department=university", None),
    ("unicorn-scaleups", "Anthropic", "anthropic.com", "https://www.anthropic.com/careers/jobs", None),
    ("unicorn-scaleups", "OpenAI", "openai.com", "https://openai.com/careers/search/", None),
    ("unicorn-scaleups", "Databricks", "databricks.com", "https://www.databricks.com/company/careers/open-positions", None),
    ("unicorn-scaleups", "Canva", "canva.com", "https://careers.canva.com/jobs/", None),
    ("unicorn-scaleups", "Rippling", "rippling.com", "https://www.rippling.com/careers/open-roles", None),
    ("unicorn-scaleups", "Ramp", "ramp.com", "https://jobs.ashbyhq.com/ramp", None),
    ("top-tech", "NVIDIA", "nvidia.com", "https://jobs.nvidia.com/careers", None),
    ("top-tech", "Microsoft", "microsoft.com", "https://apply.careers.microsoft.com/careers", None),
    ("top-tech", "Meta", "metacareers.com", "https://www.metacareers.com/jobs/", "https://www.metacareers.com/careerprograms/students/"),
    ("top-tech", "Apple", "apple.com", "https://jobs.apple.com/en-us/search", "https://www.apple.com/careers/us/students.html"),
    ("top-tech", "Amazon", "amazon.jobs", "https://www.amazon.jobs/en/", "https://www.amazon.jobs/content/en/career-programs/university"),
    ("top-tech", "Google", "google.com", "https://www.google.com/about/careers/applications/jobs/results/", None),
    ("top-tech", "Netflix", "jobs.netflix.com", "https://explore.jobs.netflix.net/careers", "https://jobs.netflix.com/careers/new-grads"),
    ("top-tech", "OpenAI", "openai.com", "https://openai.com/careers/search/", None),
    ("top-tech", "Anthropic", "anthropic.com", "https://www.anthropic.com/careers/jobs", None),
    ("top-tech", "Databricks", "databricks.com", "https://www.databricks.com/company/careers/open-positions", None),
    ("top-tech", "Stripe", "stripe.com", "https://stripe.com/jobs/search", None),
    ("top-tech", "Cloudflare", "cloudflare.com", "https://www.cloudflare.com/careers/jobs/", None),
    ("top-tech", "Snowflake", "snowflake.com", "https://careers.snowflake.com/us/en", None),
    ("top-tech", "Adobe", "adobe.com", "https://careers.adobe.com/us/en/search-results/", None),
    ("top-tech", "Uber", "uber.com", "https://jobs.uber.com/en/jobs/", None),
]


def presets(spark: SparkSession) -> DataFrame:
    schema = "preset_id string, name string, domain string, career_url string, early_careers_url string"
    return spark.createDataFrame(PRESETS, schema)
