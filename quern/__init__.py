"""quern: entity resolution, rule resolution and catalogue analytics as composable Spark plans."""
