"""Sources: testdata bindings, landed JSON feeds and their normalisation."""
