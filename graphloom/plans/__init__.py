"""Query graphs and the strategies that plan them."""
