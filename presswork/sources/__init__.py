"""Sources: the registry, captured responses, feeds, sitemaps and home pages."""
