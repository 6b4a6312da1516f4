"""Sources and stores: adapters, simulation, raw and feature stores."""
