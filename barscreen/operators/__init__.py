"""DataFrame steps that screens are composed of."""
