from leafspark.sources.samples import *  # noqa: F403
