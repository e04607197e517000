"""Task graphs and the loads of a whole run."""
