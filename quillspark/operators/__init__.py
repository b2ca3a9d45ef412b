"""The commands: frames, pixels, generic ones and the element tree."""
