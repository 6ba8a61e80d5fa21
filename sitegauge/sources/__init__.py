"""Sources: fetched site resources, sitemaps, and an optional live reader."""
