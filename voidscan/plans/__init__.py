"""Plan helpers: tables between stages, and checks of physical plans."""
