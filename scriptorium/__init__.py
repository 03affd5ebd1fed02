"""scriptorium: page-localization data operators expressed as Spark jobs."""
