"""Where source files, caches, settings and survey answers come from and go to."""
